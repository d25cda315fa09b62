"""A corpus cleaning pipeline over ``documents``, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's result as Parquet in the shared folder and gives it, read again,
to the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from settlekit.llm import decontaminate, langid, line_dedup, minhash, pieces  # noqa: E402
from settlekit.llm.common import table, written  # noqa: E402

#: A document is rejected when its language can't be told: no letters, or no
#: language reaches this calibrated probability.
MIN_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier can tell."""
    named = langid.identified(docs)
    return named.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share. All
    documents stay, also one that has no line left; n_chars follows the text."""
    cleaned = line_dedup.line_dedup(docs, min_docs=10)
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (similarity 0.8 or more)."""
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that is left."""
    out = pieces.encode(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_chars", F.size("ids").cast("long").alias("n_pieces"), "text_sha256", "ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("minhash", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Two stages fit or estimate, so SQL can't give the rows of a run; tests
#: compare it with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
