"""Buckets kept in parts: what a stream of batches writes again, and what is read."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from settlekit import masters, sinks
from settlekit.operators import merge as MG

OLD = dt.datetime(2025, 1, 1)


def batch(spark, start, n, v, at, step=1):
    return spark.range(start, start + n * step, step).select(
        F.when(F.col("id") % 11 != 0, F.concat(F.lit("o"), "id")).alias("order_release_id"), F.when(F.col("id") % 13 != 0, F.lit("1")).alias("order_line_id"),
        (F.col("id") * 100 + v).alias("v"), F.lit(at).cast("timestamp").alias("upload_timestamp"))


def rows(df):
    return sorted(map(str, df.select("order_release_id", "order_line_id", "v", "upload_timestamp").collect()))


@pytest.fixture
def root(monkeypatch):
    monkeypatch.setattr(masters, "PART_ROWS", 1)
    return tempfile.mkdtemp(prefix="parts-")


def test_which_parts_are_merged(monkeypatch):
    part = lambda n: {"path": str(n), "rows": n, "heavy": []}
    bucket = {**part(100_000), "newer": [part(50_000), part(30_000)]}
    sizes = lambda split: tuple([p["rows"] for p in x] for x in split)
    assert sizes(masters._split(None, 5)) == ([], [])
    assert sizes(masters._split(bucket, 10_000)) == ([100_000, 50_000, 30_000], [])
    assert sizes(masters._split(bucket, 30_000)) == ([], [100_000, 50_000, 30_000])
    assert sizes(masters._split({**bucket, "newer": [part(80_000), part(30_000)]}, 40_000)) == ([100_000, 80_000], [30_000])
    assert sizes(masters._split({**part(15_000), "newer": []}, 1)) == ([], [15_000])          # too small to be left
    monkeypatch.setattr(masters, "MOST_PARTS", 3)
    assert sizes(masters._split(bucket, 1)) == ([100_000, 50_000], [30_000])


def test_a_stream_of_batches_writes_a_row_again_log_times(spark, root):
    n, batches, written, want = 200, 9, 0, None
    for k in range(batches):
        # later batches overlap; one comes late, with an older upload time, one without any
        at = None if k == 5 else OLD + dt.timedelta(days=(3 if k == 6 else k // 2))
        df = batch(spark, 120 * k, n, k, at)
        version = masters.upsert(df, root, "returns", buckets=2)
        folders = os.listdir(f"{root}/returns/data")
        newest = f"{root}/returns/data/{max(folders)}"
        written += spark.read.parquet(newest).count()
        want = df if want is None else MG.merge_latest(want, df)
        want = spark.createDataFrame(want.collect(), want.schema)
    held = masters.read_manifest(spark, version)["buckets"]
    assert max(len(masters.parts(b)) for b in held.values()) > 1
    assert written < 5 * n * batches / 2           # rewritten whole each time: about 7,000
    got = sinks.read_version(spark, version)
    assert rows(got) == rows(want) and got.columns == want.columns
    assert masters.rows_held(spark, root, ["returns"]) >= got.count()


def test_parts_survive_retention_new_columns_and_hot_orders(spark, root, monkeypatch):
    monkeypatch.setattr(masters, "LEAST_ROWS", 100)
    masters.upsert(batch(spark, 0, 2000, 1, OLD), root, "orders", buckets=4)
    hot = spark.range(600).select(F.lit("hot").alias("order_release_id"), F.col("id").cast("string").alias("order_line_id"), F.lit(7).cast("long").alias("v"),
                                  F.lit(OLD).alias("upload_timestamp"), F.lit("x").alias("extra"))
    parts = masters.upsert(batch(spark, 0, 100, 2, OLD), root, "orders")       # the same upload time: the later batch wins
    assert any(len(masters.parts(b)) == 2 for b in masters.read_manifest(spark, parts)["buckets"].values())
    masters.retire(spark, root, "orders", keep=1)
    assert sinks.read_version(spark, parts).count() == MG.merge_latest(batch(spark, 0, 2000, 1, OLD), batch(spark, 0, 100, 2, OLD)).count()
    assert sinks.read_version(spark, parts).where("v % 100 = 2").count() == MG.merge_latest(batch(spark, 0, 100, 2, OLD).limit(0), batch(spark, 0, 100, 2, OLD)).count()
    before = rows(sinks.read_version(spark, parts))
    version = masters.upsert(hot, root, "orders")
    got = sinks.read_version(spark, version)
    assert rows(got.where("extra IS NULL")) == before and got.where("extra = 'x'").count() == 600
    made = masters.read_manifest(spark, version)
    assert made["salts"] and made["salts"][0][0] == "hot"
    assert masters.heavy_orders(spark, version)["hot"] == 600
