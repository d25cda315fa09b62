import random

import duckdb
import numpy as np

from settlekit.llm import decontaminate as d
from tests.llm.conftest import DOCS

ITEMS = "item_id long, text string"


def words(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "").split()


def brute_leaks(docs, items, k=5, overlap=0.5):
    """Items whose halves each have half of their five-word runs in the text."""
    out = set()
    for i, t in items:
        w = words(t)
        if not w:
            continue
        halves = [w[:len(w) // 2], w[len(w) // 2:]]
        runs = [{tuple(h[j:j + min(k, len(h))]) for j in range(len(h) - min(k, len(h)) + 1)} if h else set() for h in halves]
        for n, text in docs:
            x = words(text)
            if all(not r or sum(any(tuple(x[j:j + len(g)]) == g for j in range(len(x) - len(g) + 1)) for g in r) >= overlap * len(r) for r in runs):
                out.add((n, i))
    return out


def found(spark, docs, items, **options):
    out = d.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **options).collect()
    assert len({(r.doc_id, r.item_id) for r in out}) == len(out)
    return {(r.doc_id, r.item_id) for r in out}


def test_given_tables_against_brute_force(spark, sf_dir):
    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    items = con.execute(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet'").fetchall()
    verbatim = {(n, i) for i, t in items for n, x in docs if t in x}
    got = found(spark, docs, items)
    assert verbatim and got == verbatim
    assert got == found(spark, docs, items, block_items=7, block=3)  # several index blocks


def text(rng, n):
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else f"w{rng.randrange(3000)}" for _ in range(n))


def test_planted_items_at_every_place(spark):
    rng = random.Random(4)
    items = [(i, text(rng, n)) for i, n in enumerate([3, 8, 15, 40, 59, 64, 65, 200])]
    docs = [(i, text(rng, rng.randrange(300))) for i in range(40)]
    for i, t in items[1:]:
        for at in (0, 1, 31, 63, 64, 100, 127):
            docs.append((1000 + 1000 * i + at, text(rng, at) + " " + t.upper() + "\n" + text(rng, 90)))
    got = found(spark, docs, items)
    assert got >= {(1000 + 1000 * i + at, i) for i, _ in items[1:] for at in (0, 1, 31, 63, 64, 100, 127)}
    assert {n for n, _ in got} >= {n for n, _ in brute_leaks(docs, items[1:])}
    assert not any(n < 40 for n, i in got if i)


def test_block_max_search_loses_nothing():
    rng = np.random.default_rng(2)
    units = [(i, rng.integers(1, 60, rng.integers(5, 40)).astype(np.uint64), 3) for i in range(50)]
    df = {}
    for _, u, _ in units:
        for t in set(u.tolist()):
            df[t] = df.get(t, 0) + 1
    ix = d.Index(units, df, 50, 20.0, 0.6, 0.3, 4, 5)
    passage = np.repeat(np.arange(30), 20)
    pairs = np.unique(passage * len(ix.vocabulary) + rng.integers(0, len(ix.vocabulary), 600))
    p, t = pairs // len(ix.vocabulary), pairs % len(ix.vocabulary)
    dense = np.zeros((len(ix.vocabulary), 50))
    dense[ix.term, ix.unit] = ix.value
    want = {(q, u) for q in range(30) for u in range(50) if dense[t[p == q], u].sum() >= 1 - 1e-9}
    assert want and {(q, u) for q, u, _ in ix.search(p, t)} == want


def test_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = [(1, item), (1, item), (2, None), (3, ""), (None, "one two three four five six seven eight nine ten")]
    docs = [(1, None), (2, ""), (3, item), (3, item), (None, item), (4, " ".join(f"q{i}" for i in range(60000)) + " " + item)]
    assert found(spark, docs, items) == {(3, 1), (None, 1), (4, 1)}
    assert found(spark, [], items) == set() and found(spark, docs, []) == set()
    named = spark.createDataFrame([(n, t, "x", 1.0) for n, t in docs], "doc_id long, text string, node string, score double")
    kept = d.drop_leaks(named, spark.createDataFrame(items, ITEMS))
    assert kept.columns == named.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_question_and_answer_columns(spark):
    items = spark.createDataFrame([(1, "what is the name of the tall hill by the lake", "it is called mount example by all who live there")], "item_id long, q string, a string")
    docs = spark.createDataFrame([(1, "so what is the name of the tall hill by the lake you ask"),
                                  (2, "so what is the name of the tall hill by the lake ? it is called mount example by all who live there .")], DOCS)
    assert [r.doc_id for r in d.find_leaks(docs, items, question="q", answer="a").collect()] == [2]
