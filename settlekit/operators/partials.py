"""KPIs of the analysis kept as mergeable partial aggregates.

``partials`` reduces an analysis to one row for each (month, status, status
group, changed): counts and exact sums, a few hundred rows whatever the number
of orders. All KPIs of ``metrics.summary_row``, the status counts and the monthly
tables come from these rows. After a batch only the months that it touched are
aggregated again (``refresh``): the analysis is partitioned by month, so the
others' files are not read.

Partials are written as versions beside each other, with a pointer; a reader
never sees half of a refresh.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from settlekit import schema as S
from settlekit import sinks
from settlekit.functions import status as X
from settlekit.operators.metrics import _d, pct

MONTH, CHANGED = "settlement_month", "status_changed_this_run"
KEYS = [MONTH, "status", "status_group", CHANGED]
SUMS = ["profit_loss", "net_revenue", "commission_cost", "logistics_cost", "tax_deductions", "return_settlement", "order_settlement"]
COUNTS = ["orders", "with_revenue"]


def partials(a: DataFrame) -> DataFrame:
    """One row for each month, status, status group and changed flag."""
    return a.groupBy(*KEYS).agg(F.count("*").alias("orders"), F.count("net_revenue").alias("with_revenue"),
                                *[F.sum(c).alias(c) for c in SUMS])


def merged(p: DataFrame) -> DataFrame:
    """Partials of several parts of an analysis as the partials of the whole."""
    return p.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in [*COUNTS, *SUMS]])


def summary_row(p: DataFrame, denominator: str = "all") -> DataFrame:
    """``metrics.summary_row`` of the analysis that the partials stand for."""
    n, status = F.col("orders"), F.col("status")

    def count(rule=None):
        return F.coalesce(F.sum(n if rule is None else F.when(rule, n)), F.lit(0).cast("long"))

    def total(c):
        return F.coalesce(F.sum(c), F.lit(0).cast(S.MONEY))

    den = count() if denominator == "all" else count(F.col("status_group") != S.GROUP_CANCELLED)
    revenue, with_revenue = F.sum("net_revenue"), F.sum("with_revenue")
    changed = F.col(CHANGED)
    return p.agg(
        count().alias("total_orders"), _d(total("profit_loss")).alias("net_profit_loss"),
        pct(count(status == S.DELIVERED_SETTLED), den).alias("settlement_rate"),
        pct(count(X.is_returned(status)), den).alias("return_rate"),
        F.when(with_revenue > 0, _d(revenue) / with_revenue).alias("aov"),
        pct(total("commission_cost"), revenue).alias("commission_rate"),
        pct(total("logistics_cost"), revenue).alias("logistics_cost_ratio"),
        pct(total("tax_deductions"), revenue).alias("tax_rate"),
        _d(total("return_settlement")).alias("total_return_settlement"),
        _d(total("order_settlement")).alias("total_order_settlement"),
        count(changed).alias("status_changes"),
        count(changed & (status == S.DELIVERED_SETTLED)).alias("settlement_changes"),
        count(changed & (status == S.DELIVERED_PENDING)).alias("pending_changes"))


def by_month(p: DataFrame) -> DataFrame:
    """Orders and profit by month."""
    return p.groupBy(MONTH).agg(F.sum("orders").alias("orders"), _d(F.coalesce(F.sum("profit_loss"), F.lit(0).cast(S.MONEY))).alias("profit_loss"))


def touched_months(analyses: list[DataFrame], orders: DataFrame, key: str = "order_release_id") -> list[str | None]:
    """Months in which the given orders stand in any of the analyses (the new
    one, and the one before, where a month may lose an order)."""
    ids = orders.select(key).distinct()
    found = [a.select(key, MONTH).join(ids, key, "left_semi").select(MONTH) for a in analyses]
    months = found[0]
    for f in found[1:]:
        months = months.unionByName(f)
    return [r[0] for r in months.distinct().collect()]   # months, not orders


def in_months(a: DataFrame, months: list[str | None]) -> DataFrame:
    """Rows of the given months: a filter on the partition column alone."""
    rule = F.col(MONTH).isin([m for m in months if m is not None])
    return a.where(rule | F.col(MONTH).isNull() if None in months else rule)


def stored(spark: SparkSession, root: str) -> DataFrame | None:
    path = sinks.current_master(spark, root, "kpis")
    return spark.read.parquet(path) if path else None


def refresh(analysis: DataFrame, root: str, months: list[str | None] | None = None) -> DataFrame:
    """Bring the stored partials up to ``analysis``, of which only ``months``
    changed since (None: everything). Changed flags are of one run, so those of
    the other months are taken back."""
    spark = analysis.sparkSession
    old = stored(spark, root)
    if old is None or months is None:
        new = partials(analysis)
    else:
        again = F.coalesce(F.col(MONTH).isin([m for m in months if m is not None]), F.lit(None in months))
        kept = merged(old.where(~again).withColumn(CHANGED, F.lit(False)))
        new = kept.unionByName(partials(in_months(analysis, months)))
    version = f"{root.rstrip('/')}/kpis/v={time.time_ns():020d}"
    new.coalesce(1).write.parquet(version)   # a few hundred rows
    sinks.point_to(spark, f"{root.rstrip('/')}/kpis", version)
    return spark.read.parquet(version)
