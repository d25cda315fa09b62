"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

A *run* is a Parquet table of (h1, h2, n_docs) sorted by the hash: how many
documents of one batch hold a line. Every batch adds one run to level 0; when
a level holds ``fanout`` runs they are merged (hashes equal, counts added) into
one run of the next level, so n batches leave at most fanout * log(n) runs. A
batch is cleaned by merge-joining its line hashes with the runs: lines found
there often enough go (anti join), the others stay.

Defined results: null text counts as empty (one empty line); a line whose key
is empty is never dropped; a repeated row is a document of its own; the order
of the kept lines is the order of the text; an empty table gives an empty one.
Input columns named like an output column are replaced, all others stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from settlekit.llm.common import fresh_columns, plain_columns, row_key, work_dir

STRIP = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    """Lines of a text; null or empty gives one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """Comparison key of each line: stripped, A-Z in lower case.

    ``lower`` would also fold letters beyond ASCII. Reading the bytes as
    Latin-1 first keeps keys of different lines apart: lower-casing then moves
    lead bytes C2-DE to E2-FE only, and a moved lead byte is still followed by
    one continuation byte, where a genuine E2-FE lead byte has two or more.
    The key is used for equality only, never shown.
    """
    return F.transform(lines_of(text), lambda line: F.lower(
        F.decode(F.btrim(line, F.lit(STRIP)).cast("binary"), "ISO-8859-1")))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit(3), key).alias("h1"), F.xxhash64(F.lit(17), key).alias("h2")]


class LineRuns:
    """Levelled runs of line hashes in a shared folder."""

    def __init__(self, spark: SparkSession, root: str | None = None, fanout: int = 4):
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.spark, self.fanout = spark, fanout
        self.root = root or work_dir(spark, "line-runs")
        self.levels: list[list[str]] = []
        self._count = 0

    def _add(self, level: int, path: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            merged = f"{self.root}/level={level + 1}/run={self._next()}"
            self._merged(self.levels[level]).sortWithinPartitions("h1", "h2").write.parquet(merged)
            self.levels[level] = []
            self._add(level + 1, merged)

    def _next(self) -> int:
        self._count += 1
        return self._count

    def _merged(self, paths: list[str]) -> DataFrame:
        runs = [self.spark.read.schema("h1 long, h2 long, n_docs long").parquet(p) for p in paths]
        return reduce(DataFrame.unionByName, runs).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))

    def add_batches(self, docs: DataFrame, text: str = "text", batches: int = 1) -> None:
        """Count the distinct line keys of every document and add one run for
        each batch; the batches of one call are written in a single job."""
        keys = docs.select(
            F.pmod(row_key(*plain_columns(docs))[0], F.lit(batches)).cast("int").alias("batch"),
            F.explode(F.array_distinct(line_keys(F.col(f"`{text}`")))).alias("key"))
        counts = (keys.where(F.col("key") != "").select("batch", *_hashes(F.col("key")))
                  .groupBy("batch", "h1", "h2").agg(F.count(F.lit(1)).alias("n_docs")))
        path = f"{self.root}/level=0/call={self._next()}"
        counts.sortWithinPartitions("batch", "h1", "h2").write.partitionBy("batch").parquet(path)
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for b in range(batches):  # a batch may be empty: then it has no folder
            if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/batch={b}")):
                self._add(0, f"{path}/batch={b}")

    def frequent(self, min_docs: int) -> DataFrame:
        """(h1, h2) of the keys found in at least ``min_docs`` documents."""
        paths = [p for level in self.levels for p in level]
        if not paths:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        return self._merged(paths).where(F.col("n_docs") >= min_docs).select("h1", "h2")


def drop_lines(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the lines whose key hash is in ``known`` (h1, h2).

    Adds ``n_lines`` (before) and ``n_dropped``. Only line hashes meet the
    known ones; the text moves once, to the positions that go.
    """
    docs = fresh_columns(docs, "n_lines", "n_dropped")
    t = F.col(f"`{text}`")
    keyed = docs.withColumns(dict(zip(("__r1", "__r2"), row_key(*plain_columns(docs)))))
    slim = (keyed.select("__r1", "__r2", F.posexplode(line_keys(t)).alias("pos", "key"))
            .where(F.col("key") != "").select("__r1", "__r2", "pos", *_hashes(F.col("key"))))
    gone = (slim.join(known, ["h1", "h2"], "left_semi")
            .groupBy("__r1", "__r2").agg(F.collect_set("pos").alias("__gone")))
    n = F.size(lines_of(t))
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce(F.col("__gone"), F.array().cast("array<int>")))
    # the outer transform binds the lines once for all positions
    kept = F.transform(F.array(lines_of(t)), lambda lines: F.array_join(
        F.transform(F.col("__stay"), lambda i: F.get(lines, i)), "\n"))[0]
    out = keyed.join(gone, ["__r1", "__r2"], "left").withColumn("__stay", stay)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return out.select(*rest, F.when(F.col("__gone").isNull(), F.coalesce(t, F.lit(""))).otherwise(kept).alias(text),
                      n.cast("long").alias("n_lines"),
                      (n - F.size("__stay")).cast("long").alias("n_dropped"))


def line_dedup(docs: DataFrame, text: str = "text", min_docs: int = 10, batches: int = 4,
               runs: LineRuns | None = None) -> DataFrame:
    """Drop, in every document, all lines whose key is in ``min_docs`` documents
    or more of ``docs`` and of what ``runs`` already holds."""
    runs = runs or LineRuns(docs.sparkSession)
    runs.add_batches(docs, text, batches)
    return drop_lines(docs, runs.frequent(min_docs), text)
