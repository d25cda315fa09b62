import random

import pyarrow as pa
from pyspark.sql import functions as F

from settlekit.llm.line_dedup import LineRuns, drop_lines, line_dedup
from tests.llm.conftest import DOCS, against_oracle, save


def test_query_matches_oracle(spark, sf_dir):
    against_oracle(spark, "op6_line_dedup", sf_dir)


def test_odd_rows_match_oracle(spark, tmp_path):
    rng = random.Random(5)
    lines = ["a", "A ", "\tÉ", "é", "", " ", "x\x0b", "common", " COMMON\r", "Ã©", "ã©", "Ã\u0089", "ÀB", "àb", "one "]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 6))) for _ in range(120)] + [None, "", "\n", "common\n" * 3, "common"] * 2
    save(spark, pa.table({"doc_id": pa.array([None if i == 7 else i // 2 for i in range(len(texts))], pa.int64()), "text": texts, "h1": texts}), str(tmp_path), "documents")
    for t in ("conversations", "benchmark"):
        save(spark, pa.table({"a": [1]}), str(tmp_path), t)
    against_oracle(spark, "op6_line_dedup", str(tmp_path))


def test_empty_table_and_clashing_columns(spark):
    assert line_dedup(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame([(i, "same\nown" + str(i), 7, [1]) for i in range(3)], "doc_id long, text string, n_lines int, pos array<int>")
    out = line_dedup(docs, min_docs=3).orderBy("doc_id").collect()
    assert [(r.text, r.n_lines, r.n_dropped, r.pos) for r in out] == [(f"own{i}", 2, 1, [1]) for i in range(3)]


def test_levels_are_compacted_and_counts_survive(spark):
    runs = LineRuns(spark, fanout=2)
    for b in range(5):
        runs.add_batches(spark.createDataFrame([(b, f"shared\nonly {b}")], DOCS))
    assert [len(x) for x in runs.levels] == [1, 0, 1]  # 5 = 101 in base 2
    new = spark.createDataFrame([(9, "Shared\nonly 9\nonly 3")], DOCS)
    assert drop_lines(new, runs.frequent(5)).first().text == "only 9\nonly 3"
    assert drop_lines(new, runs.frequent(1)).first().text == "only 9"


def test_one_line_in_a_third_of_all_rows(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("hot\n"), "id")).otherwise(F.col("id").cast("string")).alias("text"))
    out = line_dedup(docs)
    assert out.agg(F.sum("n_dropped")).first()[0] == 1000 and out.where(F.col("text") == F.col("doc_id").cast("string")).count() == 3000
