"""Settlement tracking between two runs.

``current`` and ``previous`` are analysis tables. All comparisons are
anti-joins on ``order_release_id`` (hash partitioned on both sides, or a
broadcast chosen at runtime by AQE when one side measures small) — never a
per-order scan. Month keys are ``yyyy-MM`` text; ``run_month`` is the month
of the run timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from settlekit import schema as S
from settlekit.operators.metrics import _d, money_sum, pct
from settlekit.operators.skew import join_unique

KEY = "order_release_id"


def _pending(a: DataFrame) -> DataFrame:
    return a.where(F.col("status") == S.DELIVERED_PENDING)


def new_pending(current: DataFrame, previous: DataFrame | None, run_month: str) -> DataFrame:
    """Pending now, not pending in the previous run (empty without one)."""
    cur = _pending(current)
    if previous is None:
        cur = cur.limit(0)
    else:
        cur = join_unique(cur, _pending(previous).select(KEY).distinct(), KEY, "left_anti")
    return cur.select(F.col(KEY).alias("order_id"), F.lit(run_month).alias("pending_month"),
                      F.col("order_settlement").alias("settlement_amount"))


def newly_resolved(current: DataFrame, previous: DataFrame | None, run_month: str) -> DataFrame:
    """Pending in the previous run, not pending now (vanished counts too)."""
    if previous is None:
        return new_pending(current, None, run_month).select(
            "order_id", "pending_month", F.lit(run_month).alias("resolution_month"), "settlement_amount")
    prev = join_unique(_pending(previous), _pending(current).select(KEY).distinct(), KEY, "left_anti")
    return prev.select(F.col(KEY).alias("order_id"), F.col("settlement_month").alias("pending_month"),
                       F.lit(run_month).alias("resolution_month"),
                       F.col("order_settlement").alias("settlement_amount"))


def _month_counts(a: DataFrame) -> DataFrame:
    s = F.col("status")
    return (a.where(F.col("settlement_month").isNotNull())
             .groupBy(F.col("settlement_month").alias("month"))
             .agg(F.count_if(s == S.DELIVERED_SETTLED).alias("settled"),
                  F.count_if(s == S.DELIVERED_PENDING).alias("pending")))


def resolution_rates(a: DataFrame) -> DataFrame:
    """Settled / (settled + pending) per month; empty months omitted."""
    return (_month_counts(a).where(F.col("settled") + F.col("pending") > 0)
            .select("month", pct(F.col("settled"), F.col("settled") + F.col("pending"))
                    .alias("resolution_rate"))
            .orderBy("month"))


def monthly_trends(a: DataFrame) -> DataFrame:
    """Resolution rate and pending count per month."""
    return (_month_counts(a).where(F.col("settled") + F.col("pending") > 0)
            .select("month",
                    pct(F.col("settled"), F.col("settled") + F.col("pending")).alias("resolution_rate"),
                    F.col("pending").alias("pending_count")))


def brand_metrics(a: DataFrame) -> DataFrame:
    """Per brand counts and settlement values (NULL brand dropped)."""
    s = F.col("status")
    pend = s == S.DELIVERED_PENDING
    return (a.where(F.col("brand").isNotNull()).groupBy("brand")
             .agg(F.count("*").alias("total_orders"),
                  F.count_if(pend).alias("pending_settlements"),
                  F.count_if(s == S.DELIVERED_SETTLED).alias("settled_orders"),
                  _d(money_sum(F.col("order_settlement"))).alias("total_settlement_value"),
                  _d(money_sum(F.when(pend, F.col("order_settlement")))).alias("pending_settlement_value")))


def brand_trends(a: DataFrame) -> DataFrame:
    """A10: settlement rate and pending value ratio per brand."""
    m = brand_metrics(a)
    return m.select("brand",
                    pct(F.col("settled_orders"), F.col("total_orders")).alias("settlement_rate"),
                    pct(F.col("pending_settlement_value"), F.col("total_settlement_value"))
                    .alias("pending_value_ratio"))


def _month_start(m: Column) -> Column:
    return F.to_date(F.try_to_timestamp(F.concat(m, F.lit("-01")), F.lit("yyyy-MM-dd")))


def resolution_patterns(resolved: DataFrame) -> DataFrame:
    """Days between pending and resolution month; one row, or none."""
    days = F.datediff(_month_start(F.col("resolution_month")), _month_start(F.col("pending_month")))
    t = resolved.select(days.alias("d"))
    d = F.col("d")
    return (t.agg(F.count(d).alias("n"),
                  F.avg(d.cast("double")).alias("average_resolution_time"),
                  F.min(d).cast("long").alias("min_resolution_time"),
                  F.max(d).cast("long").alias("max_resolution_time"),
                  F.count_if(d <= 30).alias("days_0_30"),
                  F.count_if((d > 30) & (d <= 60)).alias("days_31_60"),
                  F.count_if((d > 60) & (d <= 90)).alias("days_61_90"),
                  F.count_if(d > 90).alias("days_90_plus"))
             .where(F.col("n") > 0).drop("n"))


def pending_vs_resolved(new_pend: DataFrame, resolved: DataFrame) -> DataFrame:
    """Months that have new pending, with the resolved count per month.

    Union of the two count streams and one aggregate — no join (the month of
    either side may be a constant, which would fold a join into a cross
    product)."""
    both = (new_pend.select(F.col("pending_month").alias("month"), F.lit(1).alias("p"), F.lit(0).alias("r"))
            .unionByName(resolved.select(F.col("resolution_month").alias("month"),
                                         F.lit(0).alias("p"), F.lit(1).alias("r"))))
    return (both.groupBy("month")
                .agg(F.sum("p").cast("long").alias("pending"), F.sum("r").cast("long").alias("resolved"))
                .where(F.col("pending") > 0))


def settlement_headline(new_pend: DataFrame, resolved: DataFrame, rates: DataFrame,
                        run_month: str) -> DataFrame:
    """Count / amount of new pending and resolved, current month rate."""
    np_ = new_pend.agg(F.count("*").alias("new_pending_count"),
                       _d(money_sum(F.col("settlement_amount"))).alias("new_pending_amount"))
    # one scalar subquery for both numbers: the anti join is planned once
    rs = resolved.agg(F.struct(F.count("*").alias("n"), _d(money_sum(F.col("settlement_amount"))).alias("amount")).alias("x")).scalar()
    rate = rates.where(F.col("month") == run_month).agg(
        F.coalesce(F.max("resolution_rate"), F.lit(0.0)).alias("current_month_resolution_rate"))
    # Three one-row aggregates side by side: each is a scalar subquery.
    return np_.select(
        "new_pending_count", "new_pending_amount",
        rs.getField("n").alias("resolved_count"),
        rs.getField("amount").alias("resolved_amount"),
        rate.select("current_month_resolution_rate").scalar().alias("current_month_resolution_rate"),
    )


def status_history(snapshots: DataFrame) -> DataFrame:
    """Status changes per order across run snapshots.

    ``snapshots``: analysis rows with a ``run_ts`` column. Each (order, run)
    is first reduced to its last status (partial aggregate), so the window
    below sees at most one row per run for an order — its partitions are
    bounded by the number of runs, not by the data."""
    per_run = (snapshots.groupBy(KEY, "run_ts")
               .agg(F.max(F.struct("order_line_id", "status")).getField("status").alias("status"),
                    F.min(F.struct("order_line_id", "brand", "order_settlement")).alias("first")))
    from pyspark.sql import Window
    w = Window.partitionBy(KEY).orderBy("run_ts")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the record an order opens with (brand, first amount) and its last status
    return (per_run.withColumn("from_status", F.lag("status").over(w))
            .withColumn("opened", F.first("first").over(whole))
            .withColumn("current_status", F.last("status").over(whole))
            .where(F.col("from_status").isNotNull() & (F.col("from_status") != F.col("status")))
            .select(KEY, F.col("opened.brand").alias("brand"), F.col("opened.order_settlement").alias("amount"), "current_status",
                    F.col("run_ts").alias("change_ts"), "from_status", F.col("status").alias("to_status")))


def settlement_report(a: DataFrame, new_pend: DataFrame, resolved: DataFrame,
                      run_month: str) -> DataFrame:
    """The settlement report as tidy rows (section, key, metric, value)."""
    def rows(df: DataFrame, section: str, key: Column, metrics: list[str]) -> DataFrame:
        return df.select(F.lit(section).alias("section"), key.cast("string").alias("key"),
                         F.explode(F.array(*[F.struct(F.lit(m).alias("metric"),
                                                      F.col(m).cast("double").alias("value"))
                                             for m in metrics])).alias("mv")
                         ).select("section", "key", "mv.metric", "mv.value")

    rates = resolution_rates(a)
    # Per-order history summary: last status, first settlement amount.
    hist = (a.groupBy(KEY)
             .agg(F.max(F.struct("order_line_id", "status")).getField("status").alias("current_status"),
                  F.min(F.struct("order_line_id", "status", "order_settlement"))
                  .getField("order_settlement").alias("amount")))
    summary = hist.agg(F.count_if(F.col("current_status") == S.DELIVERED_PENDING)
                       .alias("total_pending_settlements"),
                       _d(money_sum(F.col("amount"))).alias("total_settlement_value"))
    cur_rate = rates.where(F.col("month") == run_month).agg(
        F.coalesce(F.max("resolution_rate"), F.lit(0.0)).alias("current_resolution_rate"))
    summary = summary.select("*", cur_rate.select("current_resolution_rate").scalar()
                             .alias("current_resolution_rate"))
    pattern = resolution_patterns(resolved)
    gone = resolved.agg(F.struct(F.count("*").alias("n"), _d(money_sum(F.col("settlement_amount"))).alias("amount")).alias("x")).scalar()
    changes = (new_pend.agg(F.count("*").alias("new_pending_count"),
                            _d(money_sum(F.col("settlement_amount"))).alias("new_pending_amount"))
               .select("*",
                       gone.getField("n").alias("newly_resolved_count"),
                       gone.getField("amount").alias("newly_resolved_amount")))
    return (rows(summary, "summary", F.lit(run_month),
                 ["total_pending_settlements", "total_settlement_value", "current_resolution_rate"])
            .unionByName(rows(monthly_trends(a), "monthly", F.col("month"),
                              ["resolution_rate", "pending_count"]))
            .unionByName(rows(brand_trends(a), "brand", F.col("brand"),
                              ["settlement_rate", "pending_value_ratio"]))
            .unionByName(rows(pattern, "resolution", F.lit(""),
                              ["average_resolution_time", "days_0_30", "days_31_60",
                               "days_61_90", "days_90_plus"]))
            .unionByName(rows(changes, "recent_changes", F.lit(""),
                              ["new_pending_count", "new_pending_amount",
                               "newly_resolved_count", "newly_resolved_amount"])))
