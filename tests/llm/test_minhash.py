import random
import tracemalloc

import duckdb
import numpy as np
import pandas as pd

from settlekit.llm import minhash
from settlekit.llm.textvec import U, Words, mix, shingles_of
from tests.llm.conftest import DOCS


def shingle_set(text, k=5):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\n", " ").split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, threshold=0.8):
    """(class of every row by smallest id, links between different texts)"""
    texts = sorted({t or "" for _, t in rows})
    sets = [shingle_set(t) for t in texts]
    post = {}
    for i, s in enumerate(sets):
        for x in s:
            post.setdefault(x, []).append(i)
    pairs = {(i, j) for p in post.values() for i in p for j in p if i < j}
    links = {(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])}
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        root[find(j)] = find(i)
    at = {t: find(i) for i, t in enumerate(texts)}
    least = {}
    for d, t in rows:
        r = at[t or ""]
        least[r] = min([x for x in (least.get(r), d) if x is not None], default=None)
    return {(d, least[at[t or ""]]) for d, t in rows}, links


def words(rng, n):
    return [rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(n)]


def test_given_documents_against_brute_force(spark, sf_dir):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    out = minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r.doc_id, r.class_id) for r in out} == brute(rows)[0] and len(out) == len(rows)
    assert sum(r.kept for r in out) == len({r.class_id for r in out})


def test_one_group_of_a_third_of_the_rows(spark):
    rng = random.Random(3)
    base = words(rng, 200)
    rows = [(i, " ".join(words(rng, 120))) for i in range(300)]
    for i in range(150):  # near copies of one text: close to it, less so to each other
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(200)] = "changed" + str(rng.randrange(9999))
        rows.append((1000 + i, " ".join(copy)))
    rows.append((5000, " ".join(base)))
    # copies with a similarity of 0.5 stay apart
    rows += [(6000 + i, " ".join(base[:130] + words(rng, 70))) for i in range(20)]
    want, links = brute(rows)
    out = minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r.doc_id, r.class_id) for r in out} == want
    assert sum(r.n_links for r in out) <= 2 * len(links)


def family(rng, texts, pairs):
    """Texts on one template, at about 0.65 to each other, of which ``pairs`` come with a copy at about 0.82."""
    template = words(rng, 240)

    def filled():
        text = list(template)
        for i in range(0, 240, 24):  # each new word changes five shingles
            text[i] = f"own{rng.randrange(10 ** 9)}"
        return text

    rows = []
    for i in range(texts):
        text = filled()
        rows.append((i, " ".join(text)))
        if i < pairs:
            copy = list(text)
            for j in range(0, 240, 60):
                copy[j + 30] = f"new{rng.randrange(10 ** 9)}"
            rows.append((texts + i, " ".join(copy)))
    return rows


def test_pairs_within_a_family_that_no_leader_is_close_to(spark):
    rows = family(random.Random(8), 800, 200)
    want, links = brute(rows)
    assert len(links) >= 200
    out = minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r.doc_id, r.class_id) for r in out} == want


def test_copies_with_one_line_repeated_very_often(spark):
    rng = random.Random(10)
    rows = []
    for i in range(20):
        base, line = words(rng, 114), words(rng, 9)
        rows += [(i, " ".join(base)), (100 + i, " ".join(base + line * 400))]
    want, links = brute(rows)
    assert len(links) == 20
    out = minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r.doc_id, r.class_id) for r in out} == want


def test_similar_is_the_exact_jaccard():
    rng = random.Random(9)
    base = words(rng, 100)
    texts = [" ".join(base[:n] + words(rng, 100 - n)) for n in (100, 96, 94, 92, 90, 88, 86, 50)] + ["", "one two", "one  TWO"]
    sets = [shingle_set(t) for t in texts]
    want = [[bool(a and b) and len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets]
    assert minhash.similar(texts, 5, 0.8).tolist() == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (5, "one  TWO"), (None, "one two"), (6, "x " * 50000), (7, "x " * 49999), (8, "ünïcode é")]
    out = {(r.doc_id, r.class_id, r.class_size) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert out == {(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 4), (5, 4, 4), (None, 4, 4), (6, 6, 2), (7, 6, 2), (8, 8, 1)}
    docs = spark.createDataFrame([(d, t, "n", [1]) for d, t in rows], "doc_id long, text string, node string, bands array<int>")
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6, 8]


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert minhash.near_duplicates(empty).count() == 0 and minhash.keep_one(empty).count() == 0


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    m = 4096
    a, b = np.arange(1, 61, dtype=U), np.arange(21, 91, dtype=U)
    wa, wb = rng.uniform(1, 4, 60), rng.uniform(1, 4, 70)
    e = mix(np.concatenate((a, b)))
    sig = minhash.signatures(e, np.repeat([0, 1], [60, 70]), np.concatenate((wa, wb)), 2, m)
    xa, xb = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
    every = set(xa) | set(xb)
    exact = sum(1 / sum(max(xa.get(o, 0) / xa[i], xb.get(o, 0) / xb[i]) for o in every) for i in set(xa) & set(xb))
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03


def test_word_hashes_equal_across_batches_and_blocks(monkeypatch):
    texts = ["a bc\td", "", None, "BC A", "longer words here", "bc", "é x é"]
    whole = Words(texts)
    monkeypatch.setattr("settlekit.llm.textvec.BLOCK", 4)
    small = Words(texts)
    assert (whole.hash == small.hash).all() and whole.n.tolist() == [3, 0, 0, 2, 3, 1, 2]
    assert whole.hash[1] == whole.hash[3] == Words(["bc"]).hash[0]
    runs, owner = shingles_of(whole, 3)
    assert owner.tolist() == [0, 3, 4, 5, 6]


def test_arrays_of_a_task_stay_small_however_many_texts_a_batch_has(monkeypatch):
    rng = random.Random(11)
    texts = [" ".join(words(rng, 600)) for _ in range(1600)]
    frame = pd.DataFrame({"id": range(1600), "node": "x", "__text": texts})
    size = sum(map(len, texts))
    monkeypatch.setattr("settlekit.llm.textvec._powers", [])
    tracemalloc.start()
    try:
        signed = next(minhash._bands(5, 64, 4)(iter([frame])))
        kept, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(signed) == 1600 and size > 3 << 20
    assert most < 72 << 20 and kept < 16 << 20  # bytes: at the peak, and after
    assert signed["bands"].tolist()[7] == next(minhash._bands(5, 64, 4)(iter([frame[7:8]])))["bands"].tolist()[0]


def test_tables_of_a_very_long_word_are_not_kept(monkeypatch):
    monkeypatch.setattr("settlekit.llm.textvec._powers", [])
    monkeypatch.setattr("settlekit.llm.textvec.BLOCK", 1 << 16)
    from settlekit.llm import textvec
    long = Words(["y" * (1 << 18)]).hash
    assert sum(len(x) for x in textvec._powers) <= 2 * ((1 << 16) + 1)
    assert long[0] == Words(["a", "y" * (1 << 18)]).hash[1]
