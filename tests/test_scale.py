"""Steps whose sort, read or write by one task must not grow with the table."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from settlekit import masters
from settlekit import session as SE
from settlekit.operators import cleanse as CL
from settlekit.operators import merge as MG
from settlekit.operators import skew
from settlekit.plans import batch as BT
from settlekit.session import input_bytes, settings
from settlekit.sources import extracts as EX
from settlekit.sources import testviews as tv
from settlekit.streaming import incremental as INC

SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merge_carries_every_column_once(spark):
    rows = spark.createDataFrame([("a", "1", "x", "2025-01-01", 1), ("a", "1", "y", "2025-01-01", 2), ("a", "1", "z", "2024-01-01", 3), ("b", None, "w", None, 4)],
                                 "order_release_id string, order_line_id string, v string, t string, n long")
    rows = rows.withColumn("upload_timestamp", F.col("t").cast("timestamp")).drop("t").withColumn("_ord", F.struct("n"))
    out = MG.merge_latest(rows.limit(0), rows)
    assert sorted((r.order_release_id, r.v) for r in out.collect()) == [("a", "y"), ("b", "w")]
    partial = next(x for x in _plan(out).splitlines() if "partial_max(" in x)
    inside = partial.split("partial_max(")[1].split(")")[0]
    assert all(inside.count(f"{c}#") == 1 for c in ("v", "_ord", "upload_timestamp", "_source"))


def test_ties_within_an_extract_are_broken_by_content(spark):
    land, wh = tempfile.mkdtemp(prefix="land-"), tempfile.mkdtemp(prefix="wh-")
    header = "order_release_id,order_line_id,order_status,brand,upload_timestamp\n"
    for name, brands in (("orders-01-2025.csv", "zx"), ("orders-02-2025.csv", "bac")):
        with open(os.path.join(land, name), "w") as f:
            f.write(header + "".join(f"1,1,D,{b},2025-01-02 00:00:00\n" for b in brands))
    BT.run_batch(spark, land, wh, dt.datetime(2025, 4, 1))
    assert [r.brand for r in BT._master(spark, wh, "orders").collect()] == ["c"]   # the later extract, then the greatest row
    clean = BT._stage(spark, f"{wh}/stage", "orders", 0, (",", header.strip().split(",")), [
        BT.Extract(0, "orders-01-2025.csv", "file:" + os.path.join(land, "orders-01-2025.csv"), [os.path.join(land, "orders-01-2025.csv")])], dt.datetime(2025, 4, 1))[0]
    assert clean.schema["_ord"].dataType.names == ["extract"]


def test_first_line_sorts_narrow_rows(spark):
    d = tempfile.mkdtemp(prefix="tables-")
    day = dt.datetime(1996, 1, 1)
    spark.createDataFrame([(1, 5, "O", 1.0, day, "1-URGENT", "x" * 50), (2, 5, "O", 1.0, day, "1-URGENT", "x")],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string, o_comment string"
                          ).write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(1, 2, 7, day), (1, 1, 9, day), (1, 1, 8, day), (1, 1, 3, dt.datetime(1997, 1, 1))],
                          "l_orderkey long, l_linenumber int, l_partkey long, l_shipdate timestamp_ntz").select(
        "*", F.lit(1).cast("long").alias("l_suppkey"), F.lit(1.0).alias("l_quantity"), F.lit("R").alias("l_returnflag"), F.lit("F").alias("l_linestatus"),
        F.lit(1.0).alias("l_extendedprice"), F.lit(0.0).alias("l_discount"), F.lit(0.0).alias("l_tax")).write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(8, "Brand#1")], "p_partkey long, p_brand string").write.parquet(f"{d}/part.parquet")
    base = tv._orders_base(spark, d)
    assert {r.o_orderkey: (r.l_partkey, r.p_brand) for r in base.collect()} == {1: (8, "Brand#1"), 2: (None, None)}
    assert "l_extendedprice" not in _plan(base) and "o_comment" not in _plan(base)


def test_hot_keys_of_many_distinct_ones(spark):
    """Rare keys that share a hash with a hot one are not taken for hot."""
    n = 40000
    k = F.when(F.col("id") % 4 == 0, F.lit("H")).otherwise(F.col("id").cast("string"))
    rows = spark.range(n).select(k.alias("k"))
    assert [(r.k, r._salts) for r in skew.hot_keys(rows, "k", 1000).collect()] == [("H", 10)]
    assert skew.hot_keys(rows, "k", n).isEmpty()


def test_landed_files_grow_in_number_not_size(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="land-")
    rows = spark.range(1000).select(F.col("id").cast("string").alias("a"))
    source = f"{root}/source"
    rows.write.parquet(source)
    EX.land_files(rows, f"{root}/one/returns-06-1998.csv", source)
    monkeypatch.setattr(EX, "FILE_BYTES", 1024)
    EX.land_files(rows, f"{root}/many/returns-06-1998.csv", source)
    names = lambda k: sorted(x for x in os.listdir(f"{root}/{k}") if not x.startswith("."))
    assert names("one") == ["returns-06-1998.csv"]
    assert len(names("many")) > 3 and all(x.startswith("returns-06-1998") and x.endswith(".csv") for x in names("many"))
    assert sorted(int(r.a) for r in spark.read.option("header", True).csv(f"{root}/many").collect()) == list(range(1000))


def test_only_the_extracts_a_query_reads_are_written(spark, monkeypatch):
    monkeypatch.setattr(EX, "_DONE", {})
    monkeypatch.setattr(EX, "_WRITTEN", set())
    paths = EX.materialize(spark, SMALL, "repair")
    there = lambda k: os.path.exists(paths[k].removeprefix("file:"))
    assert there("repair") and not there("orders") and not there("returns")
    assert EX.materialize(spark, SMALL)["orders"] == paths["orders"] and there("settlement")


def test_buckets_follow_the_size(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="size-")
    with open(f"{root}/a", "w") as f:
        f.write("x" * 5000)
    assert masters.sized_buckets(spark, [f"{root}/a"]) == masters.BUCKETS
    monkeypatch.setattr(masters, "BUCKET_BYTES", 100)
    assert masters.sized_buckets(spark, [f"{root}/a"]) == 50
    monkeypatch.setattr(BT, "TARGET_PARTITION_BYTES", 100)
    assert BT._sized_buckets(spark, root, 8, 700) == 8
    assert BT._sized_buckets(spark, root, 8, 900) == 16


def test_previous_run_keeps_only_what_is_compared(spark):
    run = tv.test_run(spark, SMALL)
    assert run.previous.columns == tv.PREVIOUS_COLUMNS


def test_row_numbers_do_not_move_the_rows_twice(spark):
    rows = spark.range(10).select(F.lit("f").alias("_source_file"), F.struct(F.lit("f").alias("f"), F.lit(0).cast("long").alias("b"), F.col("id").alias("i")).alias("_ord"))
    plan = _plan(CL.row_numbers(rows))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_a_bucket_is_written_by_several_tasks(spark):
    root = tempfile.mkdtemp(prefix="masters-")
    rows = spark.range(20000).select(F.col("id").cast("string").alias("order_release_id"), F.lit("1").alias("order_line_id"),
                                     F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(None).cast("timestamp").alias("upload_timestamp"))
    # a large bucket comes from many merge tasks; these few rows are kept from being merged by one
    with settings(spark, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}):
        version = masters.upsert(rows, root, "m", buckets=2)
    manifest = masters.read_manifest(spark, version)
    for bucket in manifest["buckets"].values():
        assert sum(x.endswith(".parquet") for x in os.listdir(bucket["path"].removeprefix("file:"))) > 2
    back = masters.read_version(spark, version)
    assert back.count() == back.distinct().count() == 20000 == masters.rows_held(spark, root, ["m", "none"])


def test_a_micro_batch_is_cut_by_its_size(spark, monkeypatch):
    land, wh = tempfile.mkdtemp(prefix="land-"), tempfile.mkdtemp(prefix="wh-")
    with open(f"{land}/returns-06-1998.csv", "w") as f:
        f.write("order_release_id,order_line_id,upload_timestamp\n" + "".join(f"{i},1,2025-01-02 00:00:00\n" for i in range(500)))
    monkeypatch.setattr(SE, "LANDED_PARTITION_BYTES", 1000)
    seen, ingest = [], INC.ingest_files

    def watched(files, *args):
        conf = files.sparkSession.conf
        seen.append((int(conf.get("spark.sql.shuffle.partitions")), int(conf.get("spark.sql.files.maxPartitionBytes"))))
        return ingest(files, *args)

    monkeypatch.setattr(INC, "ingest_files", watched)
    out = INC.incremental_merge(spark, land, "returns", wh, f"{wh}/_checkpoint", dt.datetime(2025, 4, 1))
    assert out.count() == 500
    assert seen == [(-(-os.path.getsize(f"{land}/returns-06-1998.csv") // 1000), SE.STAGED_SPLIT_BYTES)]
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"


def test_persisted_frames_have_partitions_by_the_size_of_the_tables(spark, monkeypatch):
    monkeypatch.setattr(tv, "TABLE_PARTITION_BYTES", 4096)
    monkeypatch.setattr(tv, "_BASES", {})
    d = tempfile.mkdtemp(prefix="sized-")
    for t in ("orders", "lineitem", "part"):
        os.symlink(f"{SMALL}/{t}.parquet", f"{d}/{t}.parquet")
    wanted = -(-input_bytes(spark, f"{d}/lineitem.parquet", f"{d}/orders.parquet") // 4096)
    assert wanted > 8
    base = tv._orders_base(spark, d)
    assert f", {wanted})" in base._jdf.queryExecution().withCachedData().toString() + _plan(base)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"
    base.unpersist()
