import random
from collections import Counter
from itertools import permutations

import pyarrow as pa

from settlekit.llm.filter_audit import COUNTS, audit
from tests.llm.conftest import against_oracle, save

LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """Every document through every order, one by one."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    blank = str.maketrans("\t\n\x0b\x0c\r", "     ")
    fails = []
    for i, text, lang in docs:
        t = text or ""
        w = [x for x in t.translate(blank).split(" ") if x]
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
             "D": any(c in t for c in "#$%&*|"),
             "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)}
        fails.append((lang or "", i, {k for k, v in f.items() if v}))
    out, shapley = {}, Counter()
    for part in {p for p, _, _ in fails}:
        for p in permutations("ABCDE"):
            alive = [(i, f) for q, i, f in fails if q == part]
            everyone = list(alive)
            for step, letter in enumerate(p, 1):
                gone = [(i, f) for i, f in alive if letter in f]
                alive = [(i, f) for i, f in alive if letter not in f]
                shapley[part, letter] += len(gone)
                out[part, "".join(p), step] = [
                    len(alive), len(gone), sum(letter in f for _, f in everyone) - len(gone), sum(f == {letter} for _, f in everyone),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def odd_docs():
    rng = random.Random(3)
    long_text = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", " \t\n", long_text, long_text, "a " * 300, "ABC def", "x # y", long_text + " 50%", "é" * 40 + " b",
             " ".join(f"Q{i}" for i in range(210)), "big " * 200_000 + "end"]
    docs = [(i, rng.choice(texts[:-1]), rng.choice(["en", "de", "", None])) for i in range(80)]
    docs += [(5, long_text, "en"), (5, long_text, "en"), (None, long_text, "en"), (None, None, None), (200, texts[-1], "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 80, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    return docs, labels


def test_odd_rows_match_brute_force_and_oracle(spark, tmp_path):
    docs, labels = odd_docs()
    got = audit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, LABELS)).collect()
    want = brute(docs, labels)
    assert {(r.part, r.filter_order, r.step): (*[r[c] for c in COUNTS], r.shapley) for r in got} == want and len(got) == len(want)
    cols = list(zip(*docs))
    save(spark, pa.table({"doc_id": pa.array(cols[0], pa.int64()), "text": pa.array(cols[1]), "lang": pa.array(cols[2])}), str(tmp_path), "documents")
    save(spark, pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("doc_id", "quality", "toxic"), zip(*labels))}), str(tmp_path), "labels")
    against_oracle(spark, "op11_filter_audit", str(tmp_path))


def test_query_matches_oracle(spark, sf_dir):
    against_oracle(spark, "op11_filter_audit", sf_dir)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", "en", 7, [1], True)], "doc_id long, text string, lang string, mask int, steps array<int>, good boolean")
    none = spark.createDataFrame([], LABELS)
    out = audit(docs, none)
    assert out.count() == 600 and out.columns == ["part", "filter_order", "step", *COUNTS, "shapley"]
    assert audit(docs.limit(0), none).count() == 0


def test_a_text_shared_by_a_third_of_all_rows(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', concat('own ', id)) AS text", "'en' AS lang")
    row = audit(docs, spark.createDataFrame([], LABELS)).where("filter_order = 'EABCD' AND step = 1").first()
    assert (row.removed, row.kept) == (999, 2001)
