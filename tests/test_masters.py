"""Masters copied on write: what a batch rewrites, hot orders, old versions."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from settlekit import masters, sinks
from settlekit.operators import merge as MG

ROW = "order_release_id string, order_line_id string, v int, upload_timestamp timestamp"
OLD, NEW = dt.datetime(2025, 1, 1), dt.datetime(2025, 2, 1)


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def many(spark, n, v=1, at=OLD):
    return spark.range(n).select(F.concat(F.lit("o"), "id").alias("order_release_id"), F.lit("1").alias("order_line_id"),
                                 F.lit(v).alias("v"), F.lit(at).alias("upload_timestamp"))


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="masters-")


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, root):
    first = masters.upsert(many(spark, 2000), root, "orders", buckets=64)
    batch = many(spark, 10, v=2, at=NEW)
    second = masters.upsert(batch, root, "orders")
    a, b = masters.read_manifest(spark, first)["buckets"], masters.read_manifest(spark, second)["buckets"]
    changed = {n for n in b if a[n]["path"] != b[n]["path"]}
    assert a.keys() == b.keys() and len(a) == 64 and 1 <= len(changed) <= 10
    # the plan reads the folders of those buckets, and no others
    touched = masters._rows(spark, masters.read_manifest(spark, first), {int(n) for n in changed})
    assert {f.rsplit("/", 2)[-2] for f in touched.inputFiles()} == {f"settle_bucket={n}" for n in changed}
    want = MG.merge_latest(sinks.read_version(spark, first), batch)
    assert rows(sinks.read_version(spark, second).select(want.columns)) == rows(want)
    assert sinks.read_version(spark, first).where("v = 2").isEmpty()      # the older version is as it was


def test_missing_keys_new_columns_and_empty_batches(spark, root):
    old = spark.createDataFrame([("a", None, 1, OLD), (None, None, 1, OLD), ("b", "1", 1, NEW)], ROW)
    new = spark.createDataFrame([("a", None, 2, NEW, "x"), (None, None, 3, NEW, "y"), ("b", "1", 0, OLD, "z"), ("c", "1", 1, OLD, "w")], ROW + ", extra string")
    masters.upsert(old, root, "returns", buckets=4)
    version = masters.upsert(new, root, "returns")
    want = MG.merge_latest(old, new)
    assert rows(sinks.read_version(spark, version).select(want.columns)) == rows(want)
    again = masters.upsert(new.limit(0), root, "returns")
    assert rows(sinks.read_version(spark, again).select(want.columns)) == rows(want)
    none = masters.upsert(old.limit(0), root, "settlement", buckets=4)
    assert sinks.read_version(spark, none).count() == 0


def test_an_order_with_a_third_of_the_rows_fills_no_bucket(spark, root, monkeypatch):
    monkeypatch.setattr(masters, "LEAST_ROWS", 100)
    order = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("o"), "id")).alias("order_release_id")
    df = spark.range(12000).select(order, F.col("id").cast("string").alias("order_line_id"), F.lit(1).alias("v"), F.lit(OLD).alias("upload_timestamp"))
    version = masters.upsert(df, root, "orders", buckets=16)
    made = masters.read_manifest(spark, version)
    sizes = [b["rows"] for b in made["buckets"].values()]
    assert sum(sizes) == 12000 and max(sizes) <= 2 * 12000 / 16
    assert [r.order_release_id for r in masters.salt_map(spark, version).collect()] == ["hot"]
    # the map is honoured: records of the order are found again where they are
    batch = df.where("order_line_id % 300 = 0").withColumns({"v": F.lit(2), "upload_timestamp": F.lit(NEW)})
    second = masters.upsert(batch, root, "orders")
    got = sinks.read_version(spark, second)
    assert got.count() == 12000 and got.where("v = 2").count() == 40
    assert len(masters.read_manifest(spark, second)["salts"]) == 1


def test_the_hot_order_may_be_missing_and_come_later(spark, root, monkeypatch):
    monkeypatch.setattr(masters, "LEAST_ROWS", 100)
    masters.upsert(many(spark, 3000), root, "returns", buckets=8)
    late = spark.range(3000).select(F.lit(None).cast("string").alias("order_release_id"), F.col("id").cast("string").alias("order_line_id"),
                                    F.lit(5).alias("v"), F.lit(NEW).alias("upload_timestamp"))
    version = masters.upsert(late, root, "returns")
    made = masters.read_manifest(spark, version)
    assert max(b["rows"] for b in made["buckets"].values()) <= 2 * 6000 / 8 and made["salts"][0][0] is None
    got = sinks.read_version(spark, version)
    assert got.count() == 6000 and got.where("v = 5").select("order_line_id").distinct().count() == 3000


def test_a_plain_master_is_taken_over(spark, root):
    sinks.write_master(many(spark, 50), root, "orders")
    version = masters.upsert(many(spark, 60, v=2, at=NEW), root, "orders", buckets=4)
    got = sinks.read_version(spark, version)
    assert got.count() == 60 and got.where("v = 1").isEmpty()


def test_retention_keeps_what_a_snapshot_names(spark, root):
    kept = []
    for v in range(1, 6):
        kept.append(masters.upsert(many(spark, 40 if v == 1 else 3, v=v, at=OLD + dt.timedelta(days=v)), root, "orders", buckets=8))
        if v == 2:
            base = sinks.snapshot_versions(spark, root, ["orders"], f"{root}/snapshots", NEW)
            then = rows(sinks.read_snapshot(spark, base, "orders"))
    gone = masters.retire(spark, root, "orders", f"{root}/snapshots", keep=1)
    left = sorted(d for d in os.listdir(f"{root}/orders") if d.startswith("v="))
    assert left == sorted(x.rsplit("/", 1)[1] for x in (kept[1], kept[4])) and gone
    assert rows(sinks.read_snapshot(spark, base, "orders")) == then                       # as of the second run
    assert sinks.read_version(spark, sinks.current_master(spark, root, "orders")).count() == 40
    used = {b["path"].split("/data/")[1].split("/")[0] for v in (kept[1], kept[4]) for b in masters.read_manifest(spark, v)["buckets"].values()}
    assert set(os.listdir(f"{root}/orders/data")) == used
    assert masters.retire(spark, root, "orders", f"{root}/snapshots", keep=1) == []


def test_a_replayed_batch_is_known(spark, root):
    masters.upsert(many(spark, 5), root, "orders", commit="c-1")
    assert sinks.committed(spark, root, "orders", "c-1") and not sinks.committed(spark, root, "orders", "c-2")


def test_joins_read_stored_counts_of_heavy_orders(spark, root, monkeypatch):
    from settlekit.operators.skew import SALT, hot_of_counts, join_unique
    monkeypatch.setattr(masters, "LEAST_ROWS", 100)
    monkeypatch.setattr(masters, "HEAVY_ROWS", 200)
    order = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 10 == 1, F.lit("warm")).otherwise(F.concat(F.lit("o"), "id"))
    df = spark.range(6000).select(order.alias("order_release_id"), F.col("id").cast("string").alias("order_line_id"), F.lit(1).alias("v"),
                                  F.lit(OLD).alias("upload_timestamp"))
    version = masters.upsert(df, root, "orders", buckets=8)
    sc = spark.sparkContext
    sc.setJobGroup("no-jobs", "stored counts")
    counts = masters.heavy_orders(spark, version)
    stored = sinks.read_version(spark, version)
    small = spark.createDataFrame([("hot", 1), ("warm", 2)], "order_release_id string, w int")
    joined = join_unique(stored, small, "order_release_id", min_rows=500, counts=counts)
    assert len(sc.statusTracker().getJobIdsForGroup("no-jobs")) == 0
    sc.setJobGroup("others", "")
    assert counts == {"hot": 2000, "warm": df.where("order_release_id = 'warm'").count()}
    assert SALT in joined._jdf.queryExecution().toString()
    assert joined.where("w = 1").count() == 2000 and joined.count() == 6000
    assert hot_of_counts(stored, "order_release_id", counts, 10_000) is None
    # counts follow an upsert
    more = df.where("order_release_id = 'hot'").limit(300).withColumn("order_line_id", F.concat(F.lit("n"), "order_line_id"))
    assert masters.heavy_orders(spark, masters.upsert(more, root, "orders"))["hot"] == 2300
    assert masters.heavy_orders(spark, None) is None
