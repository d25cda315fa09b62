"""What a run holds on disk at once: shuffles, staging tables, landed text."""

import datetime as dt
import os
import tempfile
import time

from pyspark.sql import functions as F

from settlekit import masters, sinks
from settlekit import schema as S
from settlekit.operators import merge as MG
from settlekit.operators.analyze import analyze
from settlekit.plans import batch as BT
from settlekit.session import GZIP_TEXT, landed_bytes, settings
from settlekit.sources import csv as CSV
from settlekit.sources import extracts as EX
from settlekit.sources import testviews as tv
from settlekit.streaming import incremental as INC

RUN_TS = dt.datetime(2025, 4, 1)
ORDERS = "order_release_id,order_line_id,order_status,is_ship_rel,created_on,upload_timestamp\n"
RETURNS = "order_release_id,order_line_id,return_type,total_actual_settlement,upload_timestamp\n"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def landed():
    land = tempfile.mkdtemp(prefix="land-")
    with open(f"{land}/orders-01-2025.csv", "w") as f:
        f.write(ORDERS + "".join(f"o{i},1,D,1,2025-01-0{i % 9 + 1},2025-01-02 00:00:00\n" for i in range(50)) + "o0,1,D\n")
    with open(f"{land}/returns-01-2025.csv", "w") as f:
        f.write(RETURNS + "".join(f"o{i},1,exchange,x{i},2025-01-02 00:00:00\n" for i in range(0, 50, 3)))
    return land


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for d in manager.localDirsString() for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}


def left_over(spark, before):
    for _ in range(50):   # files are deleted beside the next jobs
        if not shuffle_files(spark) - before:
            return set()
        time.sleep(0.2)
    return shuffle_files(spark) - before


def test_a_run_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    done = BT.run_batch(spark, landed(), tempfile.mkdtemp(prefix="wh-"), RUN_TS, buckets=4, size_partitions=True)
    assert done.analysis.count() == 50
    done.summary.collect()
    written = {f for f in left_over(spark, before) if not f.endswith(".tmp")}
    # (the summary and the count are queries of the caller)
    assert len(written) <= 8


def test_a_streamed_run_leaves_no_shuffle_files(spark):
    wh, before = tempfile.mkdtemp(prefix="wh-"), shuffle_files(spark)
    INC.incremental_run(spark, landed(), wh, f"{wh}/_checkpoints", RUN_TS)
    assert left_over(spark, before) == set()
    assert INC.batch_issues(spark, wh).where("message LIKE 'Invalid %'").count() == 17
    assert not os.listdir(f"{wh}/staging")


def test_large_entities_stage_one_after_the_other(spark, monkeypatch):
    seen, ingest = [], BT._ingest_entity

    def watched(spark, warehouse, staging, entity, *args):
        root = os.path.dirname(staging)
        seen.append((entity, os.listdir(root) if os.path.exists(root) else []))
        return ingest(spark, warehouse, staging, entity, *args)

    monkeypatch.setattr(BT, "_ingest_entity", watched)
    monkeypatch.setattr(BT, "SIDE_BY_SIDE_BYTES", 1)
    wh = tempfile.mkdtemp(prefix="wh-")
    for _ in range(2):   # a rerun of the same run replaces its issues
        done = BT.run_batch(spark, landed(), wh, RUN_TS)
    assert seen == [("orders", []), ("returns", [])] * 2
    issues = spark.read.json(done.paths["issues"])
    assert issues.where("message LIKE 'Short line%'").count() == 1
    assert issues.where("message LIKE 'Invalid %'").groupBy("file_type").count().collect() == [("returns", 17)]
    assert {r.file_type for r in spark.read.json(done.paths["stats"]).collect()} == {"orders", "returns"}


def test_rows_move_once_to_their_buckets(spark):
    rows = spark.createDataFrame([("a", "1", 1, 1), ("a", "1", 2, 2), (None, "1", 3, 1), (None, "1", 4, 2), ("b", None, 5, 1), ("a", "2", 6, 1)],
                                 "order_release_id string, order_line_id string, v int, d int")
    rows = rows.select("order_release_id", "order_line_id", "v", F.make_timestamp(F.lit(2025), F.lit(1), "d", F.lit(0), F.lit(0), F.lit(0)).alias("upload_timestamp"))
    with settings(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false"}):
        for old in (rows.limit(0), rows.where("v = 6")):
            dealt, plain = MG.merge_latest(old, rows, dealt=(4, "order_release_id")), MG.merge_latest(old, rows)
            assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
            assert plan(dealt.repartition(4, "order_release_id")).count("Exchange hash") == 1 < plan(plain.repartition(4, "order_release_id")).count("Exchange hash")
        path = f"{tempfile.mkdtemp(prefix='bucketed-')}/v"
        sinks.write_version(rows.where("v IN (2, 6)"), path, 4)
        both = [MG.merge_latest_bucketed(sinks.read_version(spark, path), rows, 4, dealt=x).collect() for x in (False, True)]
        assert sorted(map(str, both[0])) == sorted(map(str, both[1]))


def test_bucketed_masters_are_joined_in_place(spark):
    money = lambda c: F.col(c).cast(S.MONEY)
    n = spark.range(300).withColumn("order_release_id", F.when(F.col("id") % 50 != 0, (F.col("id") % 200).cast("string")))
    at = F.timestamp_seconds(F.col("id") % 7)
    line = F.col("id").cast("string").alias("order_line_id")
    orders = n.select("order_release_id", line, F.lit("D").alias("order_status"), F.lit(1).cast("long").alias("is_ship_rel"),
                      F.lit("2025-01-01").cast("timestamp").alias("created_on"), money("id").alias("final_amount"), at.alias("upload_timestamp"))
    returns = n.where("id % 3 = 0").select("order_release_id", line, F.lit("exchange").alias("return_type"), money("id").alias("total_actual_settlement"), at.alias("upload_timestamp"))
    settlements = n.where("id % 2 = 0").select("order_release_id", line, *[money("id").alias(c) for c in (
        "total_actual_settlement", "total_commission", "total_logistics_deduction", "tcs_amount", "tds_amount")], at.alias("upload_timestamp"))
    root = tempfile.mkdtemp(prefix="bucketed-")
    stored = []
    for k, df in enumerate((orders, returns, settlements)):
        sinks.write_version(df, f"{root}/{k}", 4)
        stored.append(sinks.read_version(spark, f"{root}/{k}"))
    before = orders.select("order_release_id", "order_line_id", "upload_timestamp", F.lit("x").alias("status"))
    for previous in (None, before):
        want = analyze(orders, returns, settlements, previous, RUN_TS, order_col=None)
        with settings(spark, {"spark.sql.shuffle.partitions": "4", "spark.sql.autoBroadcastJoinThreshold": "-1"}):
            got = analyze(*stored, previous, RUN_TS, order_col=None, apart=True)
            assert plan(got).count("Exchange hash") == (0 if previous is None else 1)
            assert got.count() == 300 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        # a hot order is still spread
        hot = analyze(*stored, previous, RUN_TS, order_col=None, apart=True, hot_key_rows=3)
        assert "_salt" in plan(hot) and hot.exceptAll(want).isEmpty()


def test_gzip_extracts(spark, monkeypatch):
    monkeypatch.setattr(EX, "_DONE", {})
    monkeypatch.setattr(EX, "_WRITTEN", set())
    monkeypatch.setattr(tv, "_BASES", {})
    paths = EX.materialize(spark, "/root/testdata/sf0.001", "orders", "returns")
    files = [x for x in os.listdir(paths["returns"].removeprefix("file:")) if x.startswith("part-")]
    assert files and all(x.endswith(".csv.gz") for x in files)
    assert CSV.sniff(spark, paths["orders"])[0] == "\t" and CSV.sniff(spark, paths["returns"])[1][0] == "order_release_id"
    size = sum(os.path.getsize(f"{paths['returns'].removeprefix('file:')}/{x}") for x in files)
    assert landed_bytes(spark, paths["returns"], f"{paths['root']}/nothing") >= GZIP_TEXT * size
    assert not tv._BASES      # what only the files need is not kept beside them
    raw = tv.raw_returns_v(spark, "/root/testdata/sf0.001")
    assert CSV.scan_tolerant(spark, paths["returns"])[0].count() == raw.count()
    assert masters.sized_buckets(spark, [paths["returns"]]) == masters.BUCKETS
