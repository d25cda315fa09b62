"""Reports as data.

Layout is not work; the numbers are. Every report is a small tidy frame
``(block, item, text)`` (or ``(section, label, value)`` for the PDF-style
tables) built from one-row aggregates of the analysis table plus one row
per month. Report size is bounded by the number of months, never by the
number of orders. Writing it out (``sinks.write_report``) sorts by
``(block, item)`` into a single text file.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from settlekit import schema as S
from settlekit.operators import metrics as M
from settlekit.operators import track as T
from settlekit.operators.quality import completeness

# --- fixed values: report texts -----------------------------------------------------
TITLE = "=== Order Reconciliation Report ==="
RECOMMENDATIONS = [
    "1. Monitor orders with status 'Completed - Pending Settlement' to ensure they get settled.",
    "2. Analyze orders with high losses to identify patterns and potential issues.",
    "3. Investigate return patterns to reduce return rates.",
    "4. Consider strategies to increase settlement rates for shipped orders.",
]
# --- end fixed values ----------------------------------------------------------------------


def num2(x: Column) -> Column:
    """``{:.2f}``: half-up at cents of the value taken to ten decimals."""
    return F.format_string("%.2f", F.round(x.cast("decimal(38,10)"), 2).cast("double"))


def money2(x: Column) -> Column:
    """``₹{:,.2f}``."""
    return F.concat(F.lit("₹"), F.format_number(F.round(x.cast("decimal(38,10)"), 2), 2))


def report_numbers(a: DataFrame, denominator: str = "all") -> DataFrame:
    """One row with every number the text report prints."""
    g, s = F.col("status_group"), F.col("status")
    total = F.count("*")
    n = {k: F.count_if(g == v) for k, v in (("cancelled", S.GROUP_CANCELLED), ("returned", S.GROUP_RETURNED),
                                           ("settled", S.GROUP_SETTLED), ("pending", S.GROUP_PENDING))}
    den = total if denominator == "all" else total - n["cancelled"]
    changed = F.col("status_changed_this_run")
    return a.agg(
        total.alias("total_orders"), *[c.alias(f"n_{k}") for k, c in n.items()],
        *[M.pct(c, total).alias(f"p_{k}") for k, c in n.items()],
        M.money_sum(F.col("order_settlement")).alias("order_total"),
        M.money_sum(F.col("return_settlement")).alias("return_total"),
        M.money_sum(F.col("profit_loss")).alias("net"),
        M.money_sum(F.when(g == S.GROUP_PENDING, F.col("final_amount"))).alias("pending_value"),
        F.count_if(changed).alias("status_changes"),
        F.count_if(changed & (s == S.DELIVERED_SETTLED)).alias("settlement_changes"),
        F.count_if(changed & (s == S.DELIVERED_PENDING)).alias("pending_changes"),
        M.pct(F.count_if(s == S.DELIVERED_SETTLED), den).alias("settlement_rate"),
        M.pct(F.count_if(F.coalesce(s.contains("Returned"), F.lit(False))), den).alias("return_rate"),
    ).withColumns({
        "avg_profit": F.when(F.col("n_settled") > 0, F.col("order_total").cast("double") / F.col("n_settled"))
                       .otherwise(F.lit(0.0)),
        "avg_loss": F.when(F.col("n_returned") > 0, F.col("return_total").cast("double") / F.col("n_returned"))
                     .otherwise(F.lit(0.0)),
    })


def _lines(row: DataFrame, block: int, items: list[Column]) -> DataFrame:
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(block).alias("block"), F.lit(f"{i:03d}").alias("item"), t.alias("text"))
        for i, t in enumerate(items)])).alias("l")).select("l.*")


def recon_report(a: DataFrame, new_pend: DataFrame, resolved: DataFrame, run_month: str,
                 denominator: str = "all") -> DataFrame:
    """The reconciliation text report as (block, item, text)."""
    r = report_numbers(a, denominator)
    c = F.col

    def cnt(label: str, k: str) -> Column:
        return F.format_string(f"{label}: %d (%s%%)", c(f"n_{k}"), num2(c(f"p_{k}")))

    head = [F.lit(TITLE), F.lit(""), F.lit("=== Order Counts ==="),
            F.format_string("Total Orders: %d", c("total_orders")),
            cnt("Cancelled Orders", "cancelled"), cnt("Returned Orders", "returned"),
            cnt("Completed and Settled Orders", "settled"),
            cnt("Completed but Pending Settlement Orders", "pending"), F.lit(""),
            F.lit("=== Financial Analysis ==="),
            F.concat(F.lit("Total Profit from Settled Orders: "), num2(c("order_total"))),
            F.concat(F.lit("Total Loss from Returned Orders: "), num2(F.abs(c("return_total")))),
            F.concat(F.lit("Net Profit/Loss: "), num2(c("net"))), F.lit(""),
            F.lit("=== Settlement Information ==="),
            F.concat(F.lit("Total Return Settlement Amount: "), money2(F.abs(c("return_total")))),
            F.concat(F.lit("Total Order Settlement Amount: "), money2(c("order_total"))),
            F.concat(F.lit("Potential Settlement Value (Pending): "), money2(c("pending_value"))),
            F.format_string("Status Changes in This Run: %d", c("status_changes")),
            F.format_string("Orders Newly Settled in This Run: %d", c("settlement_changes")),
            F.format_string("Orders Newly Pending in This Run: %d", c("pending_changes")), F.lit(""),
            F.lit("=== Key Metrics ==="),
            F.concat(F.lit("Settlement Rate: "), num2(c("settlement_rate")), F.lit("%")),
            F.concat(F.lit("Return Rate: "), num2(c("return_rate")), F.lit("%")),
            F.concat(F.lit("Average Profit per Settled Order: "), num2(c("avg_profit"))),
            F.concat(F.lit("Average Loss per Returned Order: "), num2(F.abs(c("avg_loss"))))]
    # one scalar subquery for both numbers: the anti join is planned once
    gone = resolved.agg(F.struct(F.count("*").alias("n"), M.money_sum(F.col("settlement_amount")).alias("v")).alias("x")).scalar()
    track = (new_pend.agg(F.count("*").alias("np_n"), M.money_sum(F.col("settlement_amount")).alias("np_v"))
             .select("*", gone.getField("n").alias("rs_n"), gone.getField("v").alias("rs_v")))
    track_lines = [F.lit(""), F.lit("=== Settlement Tracking ==="), F.lit(f"Current Month: {run_month}"),
                   F.lit(""), F.lit("New Pending Settlements:"), F.format_string("Count: %d", c("np_n")),
                   F.concat(F.lit("Total Amount: "), money2(c("np_v"))), F.lit(""),
                   F.lit("Resolved Settlements:"), F.format_string("Count: %d", c("rs_n")),
                   F.concat(F.lit("Total Amount: "), money2(c("rs_v"))), F.lit(""),
                   F.lit("Settlement Resolution Rates by Month:")]
    months = T.resolution_rates(a).select(
        F.lit(4).alias("block"), F.col("month").alias("item"),
        F.concat(F.col("month"), F.lit(": "), num2(F.col("resolution_rate")), F.lit("%")).alias("text"))
    tail = [F.lit(""), F.lit("=== Recommendations ===")] + [F.lit(t) for t in RECOMMENDATIONS]
    return (_lines(r, 1, head).unionByName(_lines(track, 2, track_lines))
            .unionByName(months).unionByName(_lines(a.sparkSession.range(1), 5, tail)))


def recon_sections(a: DataFrame) -> DataFrame:
    """R2: order-count and financial tables (section, label, value)."""
    r = report_numbers(a)
    c = F.col

    def cnt(k: str) -> Column:
        return F.format_string("%d (%s%%)", c(f"n_{k}"), num2(c(f"p_{k}")))

    rows = [("Order Counts", "Total Orders", c("total_orders").cast("string")),
            ("Order Counts", "Cancelled Orders", cnt("cancelled")),
            ("Order Counts", "Returned Orders", cnt("returned")),
            ("Order Counts", "Completed and Settled", cnt("settled")),
            ("Order Counts", "Pending Settlement", cnt("pending")),
            ("Financial Analysis", "Total Profit from Settled Orders", money2(c("order_total"))),
            ("Financial Analysis", "Total Loss from Returned Orders", money2(F.abs(c("return_total")))),
            ("Financial Analysis", "Net Profit/Loss", money2(c("net")))]
    return _table(r, rows)


def _table(row: DataFrame, rows: list[tuple[str, str, Column]]) -> DataFrame:
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(s).alias("section"), F.lit(lbl).alias("label"), v.alias("value"))
        for i, (s, lbl, v) in enumerate(rows)])).alias("r")).select("r.*")


def financial_report(a: DataFrame) -> DataFrame:
    """Revenue and cost tables."""
    c = F.col
    one = a.agg(M.money_sum(F.col("order_settlement")).alias("order_total"),
                M.money_sum(F.col("return_settlement")).alias("return_total"),
                M.money_sum(F.col("profit_loss")).alias("net"),
                M.money_sum(F.col("commission_cost")).alias("commission"),
                M.money_sum(F.col("logistics_cost")).alias("logistics"))
    rows = [("Revenue Analysis", "Total Revenue", money2(c("order_total"))),
            ("Revenue Analysis", "Return Revenue", money2(F.abs(c("return_total")))),
            ("Revenue Analysis", "Net Revenue", money2(c("net"))),
            ("Cost Analysis", "Commission Costs", money2(c("commission"))),
            ("Cost Analysis", "Logistics Costs", money2(c("logistics"))),
            ("Cost Analysis", "Total Costs", money2(c("commission") + c("logistics")))]
    return _table(one, rows)


DQ_FIELDS = ["order_release_id", "status", "profit_loss", "created_on"]


def dq_report(a: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Completeness of four key fields + validation error rows."""
    comp = completeness({"analysis": a.select(*DQ_FIELDS)})
    rows = comp.select(F.col("position").alias("ord"), F.lit("Data Completeness").alias("section"),
                       F.initcap(F.regexp_replace("column", "_", " ")).alias("label"),
                       F.concat(num2(F.col("completeness")), F.lit("%")).alias("value"))
    if errors is None:
        return rows
    errs = errors.select(F.lit(100).alias("ord"), F.lit("Validation Errors").alias("section"),
                         F.col("field").alias("label"), F.col("message").alias("value"))
    return rows.unionByName(errs)


def report_by_type(a: DataFrame, report_type: str, date_from: _dt.date, date_to: _dt.date,
                   errors: DataFrame | None = None) -> DataFrame:
    """The chosen report, recomputed on the date-filtered frame."""
    f = M.filter_dates(a, date_from, date_to)
    if report_type == "financial":
        return financial_report(f)
    if report_type == "data_quality":
        return dq_report(f, errors)
    return recon_sections(f)
