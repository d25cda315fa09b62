import hashlib

import duckdb

import corpus_pipeline as cp
from settlekit.llm import langid
from tests.llm import test_decontaminate, test_minhash


def test_stages_against_brute_force(spark, sf_dir):
    con = duckdb.connect()
    rows = con.execute(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    named = {r.doc_id: r for r in langid.identified(docs).collect()}
    rows = [(i, t) for i, t in rows if named[i].lang_pred != "und" and named[i].score >= cp.MIN_SCORE]

    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
    seen = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    kept = [(i, "\n".join(x for x in (t or "").split("\n") if not key(x) or seen[key(x)] < 10)) for i, t in rows]

    least = dict(test_minhash.brute(kept)[0])
    kept = [(i, t) for i, t in kept if least[i] == i]

    items = con.execute(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet'").fetchall()
    bad = {n for n, _ in test_decontaminate.brute_leaks(kept, [(i, t) for i, t in items if any(t[:20] in x for _, x in kept)])}
    kept = [(i, t) for i, t in kept if i not in bad]

    out = cp.run(spark, sf_dir).collect()
    assert {(r.doc_id, r.text_sha256) for r in out} == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in kept}
    assert len(out) == len(kept) and 0 < len(out) < len(named) and bad
    assert all(r.n_pieces == len(r.ids) for r in out)


def test_stages_keep_the_columns_and_bear_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs.limit(0), sf_dir)
        assert out.columns == docs.columns and out.count() == 0
    assert cp.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0
