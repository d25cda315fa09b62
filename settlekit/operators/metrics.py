"""KPIs and breakdowns over the analysis table.

Global KPIs of one frame are fused into a single ``agg`` (one scan, partial
aggregation on every partition, a one-row final stage). Group-bys are hash
aggregates with map-side combine, so a hot brand / month / SKU is reduced
before the shuffle. Rates follow the reference's ``x / total * 100 if total
> 0 else 0``; division is done in double on counts or on exact decimal sums.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from settlekit import schema as S
from settlekit.functions import status as X
from settlekit.functions.dates import ts_lit


def _d(c: Column) -> Column:
    return c.cast("double")


def pct(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` when whole > 0 else 0 (never divides by zero)."""
    return F.when(whole > 0, _d(part) / _d(whole) * 100).otherwise(F.lit(0.0))


def money_sum(c: Column) -> Column:
    """pandas ``.sum()``: NULLs skipped, empty sum is 0."""
    return F.coalesce(F.sum(c), F.lit(0).cast(S.MONEY))


def mean(c: Column) -> Column:
    """pandas ``.mean()`` of a money column: NULL when nothing to average."""
    n = F.count(c)
    return F.when(n > 0, _d(F.sum(c)) / n)


def month_of(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def day_of(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


# --- A1 -----------------------------------------------------------------------
def status_counts(a: DataFrame) -> DataFrame:
    return a.where(F.col("status").isNotNull()).groupBy("status").agg(F.count("*").alias("count"))


def status_group_counts(a: DataFrame) -> DataFrame:
    return a.groupBy("status_group").agg(F.count("*").alias("count"))


# --- A2 + A3 + A33 fused -----------------------------------------------------------
def summary_row(a: DataFrame, denominator: str = "all") -> DataFrame:
    """One row with every global KPI of the analysis table.

    ``denominator='active'`` divides the two rates by non-cancelled orders,
    which reproduces the stored report of the reference.
    """
    status, changed = F.col("status"), F.col("status_changed_this_run")
    total = F.count("*")
    den = total if denominator == "all" else F.count_if(F.col("status_group") != S.GROUP_CANCELLED)
    settlement_total = F.sum("net_revenue")
    return a.agg(
        total.alias("total_orders"),
        _d(money_sum(F.col("profit_loss"))).alias("net_profit_loss"),
        pct(F.count_if(status == S.DELIVERED_SETTLED), den).alias("settlement_rate"),
        pct(F.count_if(X.is_returned(status)), den).alias("return_rate"),
        mean(F.col("net_revenue")).alias("aov"),
        pct(money_sum(F.col("commission_cost")), settlement_total).alias("commission_rate"),
        pct(money_sum(F.col("logistics_cost")), settlement_total).alias("logistics_cost_ratio"),
        pct(money_sum(F.col("tax_deductions")), settlement_total).alias("tax_rate"),
        _d(money_sum(F.col("return_settlement"))).alias("total_return_settlement"),
        _d(money_sum(F.col("order_settlement"))).alias("total_order_settlement"),
        F.count_if(changed).alias("status_changes"),
        F.count_if(changed & (status == S.DELIVERED_SETTLED)).alias("settlement_changes"),
        F.count_if(changed & (status == S.DELIVERED_PENDING)).alias("pending_changes"),
        _d(money_sum(F.col("commission_cost"))).alias("commission_costs"),
        _d(money_sum(F.col("logistics_cost"))).alias("logistics_costs"),
        _d(money_sum(F.col("commission_cost")) + money_sum(F.col("logistics_cost"))).alias("total_costs"),
    )


def core_metrics(a: DataFrame, denominator: str = "all") -> DataFrame:
    return summary_row(a, denominator).select(
        "aov", "return_rate", "settlement_rate", "net_profit_loss", "commission_rate",
        "logistics_cost_ratio", "tax_rate")


def run_summary(a: DataFrame) -> DataFrame:
    return summary_row(a).select(
        "total_orders", "net_profit_loss", "settlement_rate", "return_rate",
        "total_return_settlement", "total_order_settlement", "status_changes",
        "settlement_changes", "pending_changes")


def cost_totals(a: DataFrame) -> DataFrame:
    return summary_row(a).select("commission_costs", "logistics_costs", "total_costs")


# --- A4 / A5 / A20 / A21 -------------------------------------------------------------
def monthly_orders(a: DataFrame) -> DataFrame:
    m = month_of(F.col("created_on"))
    return a.where(m.isNotNull()).groupBy(m.alias("month")).agg(F.count("*").alias("count"))


def monthly_profit(a: DataFrame) -> DataFrame:
    m = month_of(F.col("created_on"))
    return (a.where(m.isNotNull()).groupBy(m.alias("month"))
             .agg(_d(money_sum(F.col("profit_loss"))).alias("profit_loss")))


def daily_orders(a: DataFrame) -> DataFrame:
    d = day_of(F.col("created_on"))
    return a.where(d.isNotNull()).groupBy(d.alias("order_day")).agg(F.count("*").alias("count"))


def daily_returns(a: DataFrame) -> DataFrame:
    d = day_of(F.col("created_on"))
    return (a.where(X.is_returned(F.col("status")) & d.isNotNull())
             .groupBy(d.alias("order_day"))
             .agg(F.count("order_release_id").alias("returns"),
                  _d(money_sum(F.col("return_settlement"))).alias("return_settlement")))


# --- A14 ---------------------------------------------------------------------------
def profit_histogram(a: DataFrame, bins: int = 50) -> DataFrame:
    """Equal-width histogram of profit_loss; the top edge joins the last bin.

    The range is one scalar subquery (min and max in one aggregate, computed
    once and handed to the tasks as a literal), attached as a column before
    it is used, so no row is joined with anything."""
    x = _d(F.col("profit_loss"))
    bounds = a.select(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    lo, hi = F.col("_b.lo"), F.col("_b.hi")
    width = hi - lo
    b = F.when(width > 0, F.least(F.floor((x - lo) / width * bins) + 1, F.lit(bins))).otherwise(F.lit(1))
    return (a.where(x.isNotNull())
             .select(x.alias("profit_loss"), bounds.alias("_b"))
             .groupBy(b.cast("long").alias("bin"), F.col("_b"))
             .agg(F.count("*").alias("count"))
             .select("bin",
                     (lo + width * (F.col("bin") - 1) / bins).alias("bin_lo"),
                     (lo + width * F.col("bin") / bins).alias("bin_hi"),
                     "count"))


# --- A16-A19 -------------------------------------------------------------------------
def dashboard_kpis(a: DataFrame, date_from: _dt.date, date_to: _dt.date) -> DataFrame:
    f = filter_dates(a, date_from, date_to)
    n = F.count("*")
    return f.agg(n.alias("total_orders"),
                 _d(money_sum(F.col("profit_loss"))).alias("net_profit_loss"),
                 pct(F.count_if(X.is_settled_family(F.col("status"))), n).alias("settlement_rate"),
                 pct(F.count_if(X.is_returned(F.col("status"))), n).alias("return_rate"))


def orders_overview(a: DataFrame) -> DataFrame:
    s = F.col("status")
    return a.agg(F.count("*").alias("total_orders"),
                 F.count_if(s == S.DELIVERED_SETTLED).alias("delivered_orders"),
                 F.count_if(s == S.DELIVERED_PENDING).alias("pending_orders"),
                 F.count_if(X.is_returned(s)).alias("returned_orders"))


def returns_overview(a: DataFrame) -> DataFrame:
    ret = X.is_returned(F.col("status"))
    n_ret = F.count_if(ret)
    value = money_sum(F.when(ret, F.col("return_settlement")))
    return a.agg(n_ret.alias("total_returns"),
                 pct(n_ret, F.count("*")).alias("return_rate"),
                 _d(value).alias("total_return_value"),
                 F.when(n_ret > 0, _d(value) / n_ret).otherwise(F.lit(0.0)).alias("avg_return_value"))


def brand_counts(a: DataFrame) -> DataFrame:
    return (a.where(F.col("brand").isNotNull()).groupBy("brand")
             .agg(F.count("*").alias("count")).orderBy(F.desc("count"), "brand"))


# --- J9 / J10 / O1 -------------------------------------------------------------------
def return_rate_by(a: DataFrame, key: str) -> DataFrame:
    """Returned orders / all orders per key, in one pass (no join)."""
    ret = X.is_returned(F.col("status"))
    return (a.where(F.col(key).isNotNull()).groupBy(key)
             .agg(F.count_if(ret).alias("returned_orders"),
                  _d(money_sum(F.when(ret, F.col("return_settlement")))).alias("return_settlement"),
                  F.count("*").alias("total_orders"))
             .where(F.col("returned_orders") > 0)
             .withColumn("return_rate", pct(F.col("returned_orders"), F.col("total_orders"))))


def brand_return_rate(a: DataFrame) -> DataFrame:
    return return_rate_by(a, "brand")


def sku_return_rate(a: DataFrame) -> DataFrame:
    return return_rate_by(a, "seller_sku_code")


def high_return_skus(a: DataFrame, threshold: float = 10.0) -> DataFrame:
    return (sku_return_rate(a).where(F.col("return_rate") > threshold)
            .orderBy(F.desc("return_rate"), "seller_sku_code"))


# --- A34 -------------------------------------------------------------------------------
def report_ratios(a: DataFrame, denominator: str = "all") -> DataFrame:
    """Counts and shares per status group, average profit / loss."""
    g = F.col("status_group")
    total = F.count("*")
    n = {k: F.count_if(g == v) for k, v in (("cancelled", S.GROUP_CANCELLED),
                                           ("returned", S.GROUP_RETURNED),
                                           ("settled", S.GROUP_SETTLED),
                                           ("pending", S.GROUP_PENDING))}
    den = total if denominator == "all" else total - n["cancelled"]
    order_sum = _d(money_sum(F.col("order_settlement")))
    return_sum = _d(money_sum(F.col("return_settlement")))
    return a.agg(
        total.alias("total_orders"),
        *[c.alias(f"{k}_orders") for k, c in n.items()],
        *[pct(c, total).alias(f"{k}_pct") for k, c in n.items()],
        pct(n["settled"], den).alias("settlement_rate"),
        pct(n["returned"], den).alias("return_rate"),
        F.when(n["settled"] > 0, order_sum / n["settled"]).otherwise(F.lit(0.0)).alias("avg_profit_per_settled"),
        F.when(n["returned"] > 0, F.abs(return_sum / n["returned"])).otherwise(F.lit(0.0)).alias("avg_loss_per_returned"),
    )


# --- F1-F4, F6, P20 -------------------------------------------------------------------------
def filter_dates(a: DataFrame, date_from: _dt.date, date_to: _dt.date, col: str = "created_on") -> DataFrame:
    """Inclusive date range on the date part, written as a half-open
    timestamp range so Parquet min/max statistics can prune row groups."""
    lo = ts_lit(date_from)
    hi = ts_lit(date_to + _dt.timedelta(days=1))
    return a.where((F.col(col) >= lo) & (F.col(col) < hi))


def filter_status_brand(a: DataFrame, statuses: list[str], brands: list[str]) -> DataFrame:
    return a.where(F.col("status").isin(statuses) & F.col("brand").isin(brands))


def filter_sku(a: DataFrame, pattern: str, col: str = "seller_sku_code") -> DataFrame:
    """Case-insensitive regex search; NULL never matches."""
    return a.where(F.coalesce(F.col(col).rlike("(?i)" + pattern), F.lit(False)))


def filter_returned(a: DataFrame) -> DataFrame:
    return a.where(X.is_returned(F.col("status")))


def filter_domain(a: DataFrame) -> DataFrame:
    """Widget domains: date range, distinct statuses, distinct brands (tidy)."""
    # one scan: rows are reduced to distinct (status, brand) with their range first
    small = a.groupBy("status", "brand").agg(F.min("created_on").alias("lo"), F.max("created_on").alias("hi"))

    def value(kind: str, c: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), c.alias("value"), F.col("lo").alias("lo"), F.col("hi").alias("hi"))

    domains = (small.select(F.explode(F.array(value("status", F.col("status")), value("brand", F.col("brand")),
                                              value("range", F.lit("")))).alias("x")).select("x.*")
               .where(F.col("value").isNotNull()).groupBy("kind", "value").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    ends = F.array(*[F.struct(F.lit(kind).alias("kind"), F.date_format(c, "yyyy-MM-dd").alias("value")) for kind, c in (("min_date", "lo"), ("max_date", "hi"))])
    itself = F.array(F.struct(F.col("kind"), F.col("value")))
    found = domains.select(F.explode(F.when(F.col("kind") == "range", ends).otherwise(itself)).alias("kv")).select("kv.*")
    # a table without rows still has its two (missing) dates
    none = a.agg(F.count("*").alias("n")).where("n = 0").select(F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("value")) for kind in ("min_date", "max_date")])).alias("kv")).select("kv.*")
    return found.unionByName(none)


ORDER_DETAIL_COLUMNS = ["order_release_id", "brand", "status", "created_on", "profit_loss",
                        "order_settlement", "return_settlement"]


def order_details(a: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return a.select(*(columns or ORDER_DETAIL_COLUMNS))


def payment_status(a: DataFrame) -> DataFrame:
    """C4 per order: expected = order amount, actual = settlement received."""
    return a.select("order_release_id", "order_line_id",
                    X.payment_status(F.col("final_amount"), F.col("order_settlement")).alias("payment_status"))
