"""Plan shape and skew: the properties the design relies on at scale."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from settlekit import schema as S
from settlekit.operators import merge as MG
from settlekit.operators.analyze import RETURN_PAYLOAD, analyze, first_per_order
from settlekit.sources import testviews as tv
from tests.conftest import SMALL

BAD_OPERATORS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_analysis_plan_has_no_pairs_and_combines_map_side(spark):
    o, r, s = tv.inputs(spark, SMALL)
    plan = _plan(analyze(o, r, s, None, tv.RUN_TS))
    assert not any(op in plan for op in BAD_OPERATORS)
    # the related tables are reduced per order before the one exchange
    assert "partial_min(" in plan and plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") >= 1


def test_filters_reach_the_parquet_scan(spark):
    r = tv.returns_v(spark, SMALL, tv.CUT_DATE)
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag), IsNotNull(l_shipdate), EqualTo(l_returnflag,R)" in plan


def test_merge_is_a_partial_aggregate_not_a_window(spark):
    master, incoming = tv.merge_inputs(spark, SMALL)
    plan = _plan(MG.merge_latest(master, incoming))
    assert "partial_max(" in plan and "Window" not in plan


def test_hot_key_is_reduced_before_the_shuffle(spark):
    """One order holds a third of all returns: the first return is still
    right, and the map side has already reduced it to one row per task."""
    n = 30000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.col("id").cast("string")).alias("order_release_id"),
        F.lit("return_refund").alias("return_type"),
        (F.col("id") % 97).cast(S.MONEY).alias("total_actual_settlement"),
        F.col("id").alias("_ord")).repartition(8)
    first = first_per_order(rows, RETURN_PAYLOAD, alias="r")
    hot = first.where(F.col("order_release_id") == "HOT").first()
    assert hot.r.total_actual_settlement == 0          # id 0 is the first HOT row
    assert first.count() == n - n // 3 + 1


def test_streaming_replay_is_a_no_op(spark):
    from settlekit import sinks
    from settlekit.streaming import incremental as INC
    root = tempfile.mkdtemp(prefix="stream-")
    land = os.path.join(root, "land")
    raw = tv.raw_returns_v(spark, SMALL)
    raw.write.option("header", True).csv(os.path.join(land, "returns-2025-03"))
    wh, ckpt = os.path.join(root, "wh"), os.path.join(root, "ckpt")
    run_ts = dt.datetime(2025, 4, 1)
    first = INC.incremental_merge(spark, land, "returns", wh, ckpt, run_ts)
    n = first.count()
    version = sinks.current_master(spark, f"{wh}/masters", "returns")
    # same checkpoint: nothing new to process, the master does not move
    again = INC.incremental_merge(spark, land, "returns", wh, ckpt, run_ts)
    assert again.count() == n and sinks.current_master(spark, f"{wh}/masters", "returns") == version
    # a replayed batch (same checkpoint and number) is found committed: no-op;
    # had its writer died before moving the pointer, the pointer moves now
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(land).select("path")
    pointer = f"{wh}/masters/returns/{sinks.POINTER}"
    sinks._write_text_file(spark, pointer, f"{wh}/masters/returns/v=0")
    INC.ingest_files(files, wh, run_ts, commit=INC.commit_name(ckpt, 0))
    assert sinks.current_master(spark, f"{wh}/masters", "returns") == version
    # the same number under another checkpoint is new data
    INC.ingest_files(files, wh, run_ts, commit=INC.commit_name(ckpt + "-other", 0))
    assert sinks.current_master(spark, f"{wh}/masters", "returns") != version
    keys = raw.select(*S.KEY).distinct().count()
    assert n == keys



def _skewed_inputs(spark, n):
    hot = F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.col("id").cast("string"))
    orders = spark.range(n).select(
        hot.alias("order_release_id"), F.col("id").cast("string").alias("order_line_id"),
        F.lit("D").alias("order_status"), F.lit(1).cast("long").alias("is_ship_rel"),
        F.lit("2025-01-01").cast("timestamp").alias("created_on"), F.lit(1).cast(S.MONEY).alias("final_amount"))
    returns = spark.range(0, n, 7).select(
        hot.alias("order_release_id"), F.lit("exchange").alias("return_type"),
        F.lit(2).cast(S.MONEY).alias("total_actual_settlement"), F.col("id").alias("_ord"))
    settlements = spark.createDataFrame([], "order_release_id string, total_actual_settlement decimal(18,4), _ord long")
    return orders, returns, settlements


def test_hot_order_key_is_salted_in_the_join(spark):
    """A third of all order rows share one key: it is spread over several
    salts, its partner row replicated per salt, results unchanged."""
    n = 60000
    orders, returns, settlements = _skewed_inputs(spark, n)
    salted = analyze(orders, returns, settlements, None, dt.datetime(2025, 2, 1), hot_key_rows=5000)
    plain = analyze(orders, returns, settlements, None, dt.datetime(2025, 2, 1), hot_key_rows=10 ** 9)
    plan = _plan(salted)
    assert "_salt" in plan and "_salt" not in _plan(plain)
    assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0
    returned = n // 3 + len([i for i in range(0, n, 7) if i % 3 != 0])
    got = {r.status: r.n for r in salted.groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert got == {S.RETURNED_EXCHANGED: returned, S.DELIVERED_PENDING: n - returned}
    # the hot key's rows land in ceil(20000 / 5000) = 4 different salts
    from settlekit.operators.skew import hot_keys
    assert hot_keys(orders, "order_release_id", 5000).first()._salts == 4


def test_salted_semi_and_anti_joins_match_plain_ones(spark):
    from settlekit.operators.skew import join_unique
    big = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).when(F.col("id") % 101 == 0, F.lit(None))
         .otherwise(F.col("id").cast("string")).alias("k"), F.col("id"))
    small = spark.createDataFrame([("HOT",), (None,), ("5",), ("7",)], "k string")
    for how in ("left_semi", "left_anti", "left"):
        for null_safe in (False, True):
            salted = join_unique(big, small, "k", how, min_rows=1000, null_safe=null_safe)
            plain = join_unique(big, small, "k", how, min_rows=None, null_safe=null_safe)
            assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0, (how, null_safe)


def test_master_pointer_falls_back_to_newest_complete_version(spark):
    from settlekit import sinks
    root = tempfile.mkdtemp(prefix="masters-")
    df = spark.createDataFrame([("a", "1")], "order_release_id string, order_line_id string")
    v1 = sinks.write_master(df, root, "orders")
    v2 = sinks.write_master(df.union(df), root, "orders")
    assert sinks.current_master(spark, root, "orders") == v2 and v1 < v2
    os.remove(os.path.join(root, "orders", sinks.POINTER))          # writer died before the rename
    assert sinks.current_master(spark, root, "orders").endswith(v2.rsplit("/", 1)[1])


def test_salting_works_with_packed_struct_keys(spark):
    from settlekit.operators.skew import hot_keys, join_unique
    big = spark.range(20000).select(
        F.struct(F.when(F.col("id") % 2 == 0, F.lit("H")).otherwise(F.col("id").cast("string")).alias("a"),
                 F.lit("1").alias("b")).alias("k"), F.col("id"))
    small = big.groupBy("k").count().where("count > 1").select("k")
    assert hot_keys(big, "k", 1000).count() == 1
    salted = join_unique(big, small, "k", "left_semi", min_rows=1000)
    assert salted.count() == 10000


def test_hot_null_key_is_salted_and_semantics_hold(spark):
    from settlekit.operators.skew import hot_keys, join_unique
    big = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"), F.col("id"))
    hot = hot_keys(big, "k", 2000).collect()
    assert [(r.k, r._salts) for r in hot] == [(None, 5)]
    small = spark.createDataFrame([(None,), ("1",), ("2",)], "k string")
    for how in ("left", "left_semi", "left_anti"):
        for ns in (False, True):
            salted = join_unique(big, small, "k", how, min_rows=2000, null_safe=ns)
            plain = join_unique(big, small, "k", how, min_rows=None, null_safe=ns)
            assert "_salt" in salted._jdf.queryExecution().executedPlan().toString()
            assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0, (how, ns)
