"""Metamorphic checks and the stored report's arithmetic."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from settlekit import schema as S
from settlekit.operators import merge as MG
from settlekit.operators import metrics as M
from settlekit.operators import track as T
from settlekit.plans import reports as RP
from settlekit.sources import testviews as tv
from tests.conftest import SMALL


def test_merge_twice_equals_merge_once(spark):
    master, incoming = tv.merge_inputs(spark, SMALL)
    once = MG.merge_latest(master, incoming).drop("_ord")
    twice = MG.merge_latest(MG.merge_latest(master, incoming), incoming).drop("_ord")
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
    keys = master.select(*S.KEY).union(incoming.select(*S.KEY)).distinct().count()
    assert once.count() == keys


def test_latest_wins_and_incoming_breaks_ties(spark):
    t0, t1 = dt.datetime(2025, 1, 1), dt.datetime(2025, 2, 1)
    schema = "order_release_id string, order_line_id string, v string, upload_timestamp timestamp"
    master = spark.createDataFrame([("a", "1", "old", t1), ("b", "1", "keep", t1)], schema)
    incoming = spark.createDataFrame([("a", "1", "new", t1), ("b", "1", "stale", t0), ("c", "1", "ins", None)],
                                     schema)
    got = {r.order_release_id: r.v for r in MG.merge_latest(master, incoming, order_col=None).collect()}
    assert got == {"a": "new", "b": "keep", "c": "ins"}
    st = MG.merge_stats(master, incoming).first()
    assert (st.total_rows, st.new_records, st.updated_records, st.inserted_keys, st.updated_keys) == (3, 3, 1, 1, 2)


def test_status_counts_sum_to_total_and_tracking_is_disjoint(spark):
    run = tv.test_run(spark, SMALL)
    a = run.analysis
    total = a.count()
    assert M.status_counts(a).agg(F.sum("count")).first()[0] == total
    np_ = T.new_pending(a, run.previous, run.run_month)
    rs = T.newly_resolved(a, run.previous, run.run_month)
    assert np_.join(rs, "order_id").count() == 0


def test_stored_report_arithmetic(spark):
    """3,995 orders = 134 + 326 + 1,551 + 1,984; the stored rates are over the
    3,861 non-cancelled orders: 40.17 % settled and 8.44 % returned."""
    rows = ([(S.CANCELLED_NO_IMPACT, S.GROUP_CANCELLED)] * 134 + [(S.RETURNED_REFUNDED, S.GROUP_RETURNED)] * 326
            + [(S.DELIVERED_SETTLED, S.GROUP_SETTLED)] * 1551 + [(S.DELIVERED_PENDING, S.GROUP_PENDING)] * 1984)
    a = (spark.createDataFrame(rows, "status string, status_group string")
         .withColumn("order_settlement", F.when(F.col("status_group") == S.GROUP_SETTLED,
                                                F.lit(Decimal("763763.25") / 1551)).cast(S.MONEY))
         .withColumn("return_settlement", F.lit(0).cast(S.MONEY)))
    r = M.report_ratios(a, denominator="active").first()
    assert (r.total_orders, r.cancelled_orders, r.returned_orders, r.settled_orders, r.pending_orders) == \
           (3995, 134, 326, 1551, 1984)
    assert round(r.settlement_rate, 2) == 40.17 and round(r.return_rate, 2) == 8.44
    assert round(r.cancelled_pct, 2) == 3.35 and round(r.pending_pct, 2) == 49.66
    assert round(r.avg_profit_per_settled, 2) == 492.43
    assert RP.RECOMMENDATIONS[0].startswith("1. Monitor")


def test_batch_run_twice_tracks_changes_against_the_first(spark):
    """Second run over the same landing: masters re-upserted (idempotent),
    previous analysis = the first run's, so nothing changes status."""
    import tempfile
    from settlekit.plans.batch import run_batch
    from settlekit.sources import extracts as EX
    p = EX.materialize(spark, SMALL)
    wh = tempfile.mkdtemp(prefix="wh-")
    first = run_batch(spark, p["landing"], wh, dt.datetime(1998, 7, 1))
    n = first.analysis.count()
    second = run_batch(spark, p["landing"], wh, dt.datetime(1998, 7, 1))
    s = second.summary.first()
    assert s.total_orders == n and s.status_changes == 0
    assert second.analysis.where("previous_status is null").count() == 0


def test_incremental_run_matches_the_batch_run(spark):
    """The streamed ingest + re-analysis gives the batch run's analysis."""
    import tempfile
    from settlekit.plans.batch import run_batch
    from settlekit.sources import extracts as EX
    from settlekit.streaming.incremental import incremental_run
    p = EX.materialize(spark, SMALL)
    run_ts = dt.datetime(1998, 7, 1)
    batch = run_batch(spark, p["landing"], tempfile.mkdtemp(prefix="wh-b-"), run_ts).analysis
    root = tempfile.mkdtemp(prefix="wh-s-")
    streamed, previous = incremental_run(spark, p["landing"], root, root + "/ckpt", run_ts, files_per_batch=2)
    assert previous is None
    cols = ["order_release_id", "order_line_id", "status", "profit_loss", "order_settlement", "return_settlement"]
    assert batch.select(*cols).exceptAll(streamed.select(*cols)).count() == 0
    assert streamed.count() == batch.count()


def test_bucketed_masters_skip_the_orders_shuffle(spark):
    import tempfile
    from settlekit.plans.batch import run_batch
    from settlekit.plans.batch import _master
    from settlekit.operators.analyze import analyze
    from settlekit.sources import extracts as EX
    p = EX.materialize(spark, SMALL)
    wh = tempfile.mkdtemp(prefix="wh-bkt-")
    res = run_batch(spark, p["landing"], wh, dt.datetime(1998, 7, 1), buckets=4)
    plain = run_batch(spark, p["landing"], tempfile.mkdtemp(prefix="wh-pl-"), dt.datetime(1998, 7, 1))
    assert res.analysis.drop("settlement_month").exceptAll(plain.analysis.drop("settlement_month")).count() == 0
    orders = _master(spark, wh, "orders")
    a = analyze(orders, _master(spark, wh, "returns"), _master(spark, wh, "settlement"), None,
                dt.datetime(1998, 7, 1), order_col=None)
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan


def test_batch_run_writes_timestamped_and_latest_report(spark):
    import tempfile
    from settlekit.plans.batch import run_batch
    from settlekit.sources import extracts as EX
    p = EX.materialize(spark, SMALL)
    res = run_batch(spark, p["landing"], tempfile.mkdtemp(prefix="wh-rep-"), dt.datetime(1998, 7, 1))
    a = [r.value for r in spark.read.text(res.paths["report"]).collect()]
    b = [r.value for r in spark.read.text(res.paths["report_latest"]).collect()]
    assert a == b and a[0] == "=== Order Reconciliation Report ===" and a[-1].startswith("4. ")


def test_bucketed_merge_matches_the_union_merge_without_shuffling_the_master(spark):
    import tempfile
    from settlekit import sinks
    master, incoming = tv.merge_inputs(spark, SMALL)
    root = tempfile.mkdtemp(prefix="bm-")
    base = MG.merge_latest(master.limit(0), master).drop("_ord")
    v = sinks.write_master(base, root, "lines", buckets=4)
    stored = sinks.read_version(spark, v)
    want = MG.merge_latest(stored, incoming).drop("_ord")
    got = MG.merge_latest_bucketed(stored, incoming, 4)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    from settlekit.session import settings
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"}):
        plan = MG.merge_latest_bucketed(stored, incoming, 4)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    scan_lines = [l for l in plan.splitlines() if "Bucketed: true" in l]
    assert scan_lines, plan
    # exchanges: the incoming rows by key (reduced before it), then by bucket;
    # and the rows with a missing key part, merged apart. None for the master.
    assert plan.count("Exchange hashpartitioning") == 3, plan


def test_bucketed_batch_rerun_matches_plain_rerun(spark):
    """Second run on bucketed masters takes the shuffle-free merge and gives
    the same masters and analysis as the plain path."""
    import tempfile
    from settlekit.plans.batch import _master, run_batch
    from settlekit.sources import extracts as EX
    p = EX.materialize(spark, SMALL)
    run_ts = dt.datetime(1998, 7, 1)
    wb, wp = tempfile.mkdtemp(prefix="wh-b2-"), tempfile.mkdtemp(prefix="wh-p2-")
    for _ in range(2):
        b = run_batch(spark, p["landing"], wb, run_ts, buckets=4)
        pl = run_batch(spark, p["landing"], wp, run_ts)
    for e in ("orders", "returns", "settlement"):
        x, y = _master(spark, wb, e), _master(spark, wp, e)
        assert x.exceptAll(y.select(*x.columns)).count() == 0 and y.count() == x.count()
    cols = [c for c in b.analysis.columns if c != "settlement_update_run_timestamp"]
    assert b.analysis.select(*cols).exceptAll(pl.analysis.select(*cols)).count() == 0


def test_bucketed_incremental_run_matches_the_batch_run(spark):
    import tempfile
    from settlekit.plans.batch import run_batch
    from settlekit.sources import extracts as EX
    from settlekit.streaming.incremental import incremental_run
    p = EX.materialize(spark, SMALL)
    run_ts = dt.datetime(1998, 7, 1)
    batch = run_batch(spark, p["landing"], tempfile.mkdtemp(prefix="wh-b3-"), run_ts).analysis
    root = tempfile.mkdtemp(prefix="wh-s3-")
    streamed, _ = incremental_run(spark, p["landing"], root, root + "/ckpt", run_ts, files_per_batch=2, buckets=4)
    cols = ["order_release_id", "order_line_id", "status", "profit_loss", "order_settlement", "return_settlement"]
    assert batch.select(*cols).exceptAll(streamed.select(*cols)).count() == 0
    assert streamed.count() == batch.count()


def test_text_report_reproduces_the_stored_report_lines(spark):
    """Stored report: 3995 orders = 134 + 326 + 1551 + 1984, profit 763,763.25 over
    the settled, loss 66,386.99 over the returned; rates over non-cancelled."""
    rows = ([(S.CANCELLED_NO_IMPACT, S.GROUP_CANCELLED, "0", "0")] * 134
            + [(S.RETURNED_REFUNDED, S.GROUP_RETURNED, "0", "203.6410")] * 325
            + [(S.RETURNED_REFUNDED, S.GROUP_RETURNED, "0", str(Decimal("66386.99") - Decimal("203.6410") * 325))]
            + [(S.DELIVERED_SETTLED, S.GROUP_SETTLED, "492.4327", "0")] * 1550
            + [(S.DELIVERED_SETTLED, S.GROUP_SETTLED, str(Decimal("763763.25") - Decimal("492.4327") * 1550), "0")]
            + [(S.DELIVERED_PENDING, S.GROUP_PENDING, "0", "0")] * 1984)
    a = (spark.createDataFrame(rows, "status string, status_group string, os string, rs string")
         .select("status", "status_group",
                 F.col("os").cast(S.MONEY).alias("order_settlement"),
                 F.col("rs").cast(S.MONEY).alias("return_settlement"),
                 (F.col("os").cast(S.MONEY) - F.col("rs").cast(S.MONEY)).cast(S.MONEY).alias("profit_loss"),
                 F.lit(0).cast(S.MONEY).alias("final_amount"), F.lit(False).alias("status_changed_this_run"),
                 F.lit("2025-03").alias("settlement_month")))
    empty = spark.createDataFrame([], "order_id string, pending_month string, resolution_month string, "
                                      "settlement_amount decimal(18,4)")
    lines = [r.text for r in RP.recon_report(a, empty, empty, "2025-03", denominator="active")
             .orderBy("block", "item").collect()]
    for want in ["Total Orders: 3995", "Cancelled Orders: 134 (3.35%)", "Returned Orders: 326 (8.16%)",
                 "Completed and Settled Orders: 1551 (38.82%)",
                 "Completed but Pending Settlement Orders: 1984 (49.66%)",
                 "Total Profit from Settled Orders: 763763.25", "Total Loss from Returned Orders: 66386.99",
                 "Net Profit/Loss: 697376.26", "Settlement Rate: 40.17%", "Return Rate: 8.44%",
                 "Average Profit per Settled Order: 492.43", "Average Loss per Returned Order: 203.64"]:
        assert want in lines, (want, lines[:30])
