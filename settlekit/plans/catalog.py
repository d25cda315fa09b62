"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query runs the library operator on the adapter run over the whole
test tables (``testviews.test_run``) and presents the result (money as
double, timestamps as text). The DuckDB oracle for each name lives in
``oracle_sql.py`` at the repository root.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from settlekit import schema as S
from settlekit.functions import dates as DT
from settlekit.functions import numbers as NU
from settlekit.functions import status as X
from settlekit.functions import text as TX
from settlekit.operators import anomaly as AN
from settlekit.operators import cleanse as CL
from settlekit.operators import merge as MG
from settlekit.operators import metrics as M
from settlekit.operators import partials as PA
from settlekit.operators import quality as QA
from settlekit.operators import track as T
from settlekit.plans import batch as BT
from settlekit.plans import reports as RP
from settlekit.plans.present import present
from settlekit.sources import csv as CSV
from settlekit.sources import extracts as EX
from settlekit.sources import testviews as tv
from settlekit.streaming import incremental as INC

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# --- fixed values: slice parameters used by the registered filter queries ---
DATE_FROM, DATE_TO = _dt.date(1996, 1, 1), _dt.date(1996, 12, 31)
SLICE_STATUSES = [S.RETURNED_REFUNDED, S.DELIVERED_SETTLED, S.DELIVERED_PENDING]
SLICE_BRANDS = ["Brand#12", "Brand#23", "Brand#4"]
SKU_PATTERN = r"sku-1\d$"
# --- end fixed values ---------------------------------------------------------


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _a(spark: SparkSession, sf: str) -> DataFrame:
    return tv.test_run(spark, sf).analysis


def _run(spark: SparkSession, sf: str):
    return tv.test_run(spark, sf)


_MEMO: dict = {}


def _memo(spark: SparkSession, sf: str, name: str, build):
    """Frames shared by several queries of one run, built once per session
    (building a key join checks for hot keys, which is a small job)."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _MEMO:
        _MEMO[key] = build()
    return _MEMO[key]


def _tracking(spark: SparkSession, sf: str):
    run = _run(spark, sf)
    np_, rs = _memo(spark, sf, "tracking", lambda: (
        T.new_pending(run.analysis, run.previous, run.run_month),
        T.newly_resolved(run.analysis, run.previous, run.run_month)))
    return run, np_, rs


# --- C6 and its parts -------------------------------------------------------------
@register("analysis")
def q_analysis(spark, sf):
    return present(_a(spark, sf))


@register("order_status")
def q_order_status(spark, sf):
    return present(_a(spark, sf).select("order_release_id", "order_line_id", "status"))


@register("profit_loss")
def q_profit_loss(spark, sf):
    return present(_a(spark, sf).select("order_release_id", "order_line_id", "profit_loss",
                                        "return_settlement", "order_settlement"))


@register("financial_breakdown")
def q_financial_breakdown(spark, sf):
    return present(_a(spark, sf).select("order_release_id", "order_line_id", "net_revenue",
                                        "commission_cost", "logistics_cost", "tax_deductions",
                                        "net_profit_loss"))


@register("payment_status")
def q_payment_status(spark, sf):
    return present(M.payment_status(_a(spark, sf)))


@register("status_label")
def q_status_label(spark, sf):
    a = _a(spark, sf)
    return (a.groupBy("order_status")
             .agg(F.count("*").alias("count"))
             .select("order_status", X.status_label(F.col("order_status")).alias("status_label"), "count"))


@register("status_group")
def q_status_group(spark, sf):
    return M.status_group_counts(_a(spark, sf))


@register("orders_returns")
def q_orders_returns(spark, sf):
    from settlekit.operators.analyze import RETURN_PAYLOAD, first_per_order
    o, r, _ = tv.inputs(spark, sf)
    fr = first_per_order(r, RETURN_PAYLOAD, alias="r")
    return present(o.select("order_release_id").join(fr, "order_release_id", "left").select(
        "order_release_id", F.col("r.return_type").alias("first_return_type"),
        F.coalesce(F.col("r.total_actual_settlement"), F.lit(0).cast(S.MONEY)).alias("return_settlement")))


@register("orders_settlements")
def q_orders_settlements(spark, sf):
    from settlekit.operators.analyze import SETTLEMENT_PAYLOAD, first_per_order
    o, _, s = tv.inputs(spark, sf)
    fs = first_per_order(s, SETTLEMENT_PAYLOAD, alias="s")
    return present(o.select("order_release_id").join(fs, "order_release_id", "left").select(
        "order_release_id",
        F.coalesce(F.col("s.total_actual_settlement"), F.lit(0).cast(S.MONEY)).alias("order_settlement"),
        F.col("s.total_commission").alias("commission_cost"),
        F.col("s.total_logistics_deduction").alias("logistics_cost"),
        (F.col("s.tcs_amount") + F.col("s.tds_amount")).cast(S.MONEY).alias("tax_deductions")))


@register("status_changes")
def q_status_changes(spark, sf):
    a = _a(spark, sf)
    return present(a.where("status_changed_this_run").select(
        "order_release_id", "previous_status", "status", "settlement_update_run_timestamp"))


# --- aggregations ---------------------------------------------------------------
@register("status_counts")
def q_status_counts(spark, sf):
    return M.status_counts(_a(spark, sf))


@register("core_metrics")
def q_core_metrics(spark, sf):
    return M.core_metrics(_a(spark, sf))


@register("core_metrics_active")
def q_core_metrics_active(spark, sf):
    return M.core_metrics(_a(spark, sf), denominator="active")


@register("run_summary")
def q_run_summary(spark, sf):
    return M.run_summary(_a(spark, sf))


def _kpis(spark, sf):
    """Partials of an analysis without its last two months, brought up to the
    whole one by those two months alone."""
    def build():
        import uuid

        from settlekit import sinks as SK
        from settlekit.session import checkpoint_dir
        root = f"{checkpoint_dir(spark).rstrip('/')}/kpis/{uuid.uuid4().hex}"
        SK.write_analysis(_a(spark, sf), f"{root}/analysis")
        whole = spark.read.parquet(f"{root}/analysis")
        last = [r[0] for r in whole.select("settlement_month").distinct().orderBy(F.col("settlement_month").desc_nulls_last()).limit(2).collect()]
        PA.refresh(whole.where(~F.col("settlement_month").isin(last) | F.col("settlement_month").isNull()), root)
        return PA.refresh(whole, root, last)
    return _memo(spark, sf, "kpis", build)


@register("incremental_kpis")
def q_incremental_kpis(spark, sf):
    """A2 from partial aggregates after a batch of two months."""
    return PA.summary_row(_kpis(spark, sf)).select("aov", "return_rate", "settlement_rate", "net_profit_loss", "commission_rate",
                                                   "logistics_cost_ratio", "tax_rate")


@register("incremental_months")
def q_incremental_months(spark, sf):
    """A4 / A5 by settlement month from the same partials."""
    return PA.by_month(_kpis(spark, sf))


@register("monthly_orders")
def q_monthly_orders(spark, sf):
    return M.monthly_orders(_a(spark, sf))


@register("monthly_profit")
def q_monthly_profit(spark, sf):
    return M.monthly_profit(_a(spark, sf))


@register("profit_histogram")
def q_profit_histogram(spark, sf):
    return M.profit_histogram(_a(spark, sf))


@register("dashboard_kpis")
def q_dashboard_kpis(spark, sf):
    return M.dashboard_kpis(_a(spark, sf), DATE_FROM, DATE_TO)


@register("orders_overview")
def q_orders_overview(spark, sf):
    return M.orders_overview(_a(spark, sf))


@register("returns_overview")
def q_returns_overview(spark, sf):
    return M.returns_overview(_a(spark, sf))


@register("brand_counts")
def q_brand_counts(spark, sf):
    return M.brand_counts(_a(spark, sf))


@register("daily_orders")
def q_daily_orders(spark, sf):
    return M.daily_orders(_a(spark, sf))


@register("daily_returns")
def q_daily_returns(spark, sf):
    return M.daily_returns(_a(spark, sf))


@register("brand_return_rate")
def q_brand_return_rate(spark, sf):
    return M.brand_return_rate(_a(spark, sf))


@register("sku_return_rate")
def q_sku_return_rate(spark, sf):
    return M.sku_return_rate(_a(spark, sf))


@register("high_return_skus")
def q_high_return_skus(spark, sf):
    return M.high_return_skus(_a(spark, sf))


@register("cost_totals")
def q_cost_totals(spark, sf):
    return M.cost_totals(_a(spark, sf))


@register("report_ratios")
def q_report_ratios(spark, sf):
    return M.report_ratios(_a(spark, sf))


@register("report_ratios_active")
def q_report_ratios_active(spark, sf):
    return M.report_ratios(_a(spark, sf), denominator="active")


# --- filters ------------------------------------------------------------------------
@register("filter_dates")
def q_filter_dates(spark, sf):
    return present(M.order_details(M.filter_dates(_a(spark, sf), DATE_FROM, DATE_TO)))


@register("filter_status_brand")
def q_filter_status_brand(spark, sf):
    return present(M.order_details(M.filter_status_brand(_a(spark, sf), SLICE_STATUSES, SLICE_BRANDS)))


@register("filter_sku")
def q_filter_sku(spark, sf):
    return present(M.order_details(M.filter_sku(_a(spark, sf), SKU_PATTERN),
                                   ["order_release_id", "seller_sku_code", "status"]))


@register("filter_returned")
def q_filter_returned(spark, sf):
    return present(M.order_details(M.filter_returned(_a(spark, sf))))


@register("filter_domain")
def q_filter_domain(spark, sf):
    return M.filter_domain(_a(spark, sf))


@register("order_details")
def q_order_details(spark, sf):
    return present(M.order_details(_a(spark, sf)))


# --- settlement tracking -------------------------------------------------------------
@register("new_pending")
def q_new_pending(spark, sf):
    _, np_, _ = _tracking(spark, sf)
    return present(np_)


@register("newly_resolved")
def q_newly_resolved(spark, sf):
    _, _, rs = _tracking(spark, sf)
    return present(rs)


@register("resolution_rates")
def q_resolution_rates(spark, sf):
    return T.resolution_rates(_a(spark, sf))


@register("brand_metrics")
def q_brand_metrics(spark, sf):
    return T.brand_metrics(_a(spark, sf))


@register("resolution_patterns")
def q_resolution_patterns(spark, sf):
    _, _, rs = _tracking(spark, sf)
    return T.resolution_patterns(rs)


@register("monthly_trends")
def q_monthly_trends(spark, sf):
    return T.monthly_trends(_a(spark, sf))


@register("brand_trends")
def q_brand_trends(spark, sf):
    return T.brand_trends(_a(spark, sf))


@register("pending_vs_resolved")
def q_pending_vs_resolved(spark, sf):
    _, np_, rs = _tracking(spark, sf)
    return T.pending_vs_resolved(np_, rs)


@register("settlement_headline")
def q_settlement_headline(spark, sf):
    run, np_, rs = _tracking(spark, sf)
    return T.settlement_headline(np_, rs, T.resolution_rates(run.analysis), run.run_month)


@register("settlement_report")
def q_settlement_report(spark, sf):
    run, np_, rs = _tracking(spark, sf)
    return T.settlement_report(run.analysis, np_, rs, run.run_month)


@register("status_history")
def q_status_history(spark, sf):
    run = _run(spark, sf)
    snaps = (run.previous.withColumn("run_ts", DT.ts_lit(run.previous_run_ts))
             .unionByName(run.analysis.select(run.previous.columns).withColumn("run_ts", DT.ts_lit(run.run_ts))))
    return present(T.status_history(snaps))


# --- anomalies ------------------------------------------------------------------------
@register("anomalies")
def q_anomalies(spark, sf):
    return present(AN.anomalies(_a(spark, sf)))


@register("anomaly_kpis")
def q_anomaly_kpis(spark, sf):
    a = _a(spark, sf)
    return AN.anomaly_kpis(AN.anomalies(a), a)


def all_queries() -> dict[str, Query]:
    """Every registered query (importing the modules that register more)."""
    return dict(QUERIES)


# --- cleansing (P1-P18, A24, A29, A30) ---------------------------------------------------

# --- fixed values: parameters of the registered string check ------------------------
STRING_MAX_LENGTH, STRING_PATTERN = 7, "SKU-1"
# --- end fixed values ------------------------------------------------------------------


def _raw(spark, sf):
    return tv.raw_orders_v(spark, sf)


def _run_ts():
    return DT.ts_lit(tv.RUN_TS)


def _clean(spark, sf, file_type="orders", policy="default"):
    raws = {"orders": _raw, "returns": tv.raw_returns_v, "settlement": tv.raw_settlement_v}
    return CL.clean(raws[file_type](spark, sf), file_type, policy, tv.RUN_TS)


@register("rename_cols")
def q_rename_cols(spark, sf):
    return CL.rename_columns(_raw(spark, sf), "orders")


@register("essential_projection")
def q_essential_projection(spark, sf):
    return CL.essential_projection(CL.rename_columns(_raw(spark, sf), "orders"), "orders")


@register("fill_missing")
def q_fill_missing(spark, sf):
    df = CL.essential_projection(CL.rename_columns(_raw(spark, sf), "orders"), "orders")
    return present(CL.fill_missing(df, "orders", "validate", tv.RUN_TS))


@register("fill_missing_read")
def q_fill_missing_read(spark, sf):
    """Reader fill: required columns only, dates get the run time."""
    df = CL.essential_projection(CL.rename_columns(_raw(spark, sf), "orders"), "orders")
    return present(CL.fill_missing(df, "orders", "read", tv.RUN_TS))


@register("fill_missing_repair")
def q_fill_missing_repair(spark, sf):
    """Repair fill: every schema column, dates get the run time."""
    df = CL.essential_projection(CL.rename_columns(_raw(spark, sf), "orders"), "orders")
    return present(CL.fill_missing(df, "orders", "repair", tv.RUN_TS))


@register("upload_stamp")
def q_upload_stamp(spark, sf):
    """Added where absent, kept where the extract has it."""
    added = CL.clean(_raw(spark, sf), "orders", "default", tv.RUN_TS).df.select("order_release_id", "upload_timestamp")
    kept = CL.clean(tv.raw_returns_v(spark, sf), "returns", "default", tv.RUN_TS).df.select("order_release_id", "upload_timestamp")
    return present(added.unionByName(kept))


@register("drop_empty")
def q_drop_empty(spark, sf):
    return CL.drop_empty_rows(tv.raw_orders_with_blanks_v(spark, sf))


@register("date_default")
def q_date_default(spark, sf):
    raw = _raw(spark, sf)
    return present(raw.select(F.col("order release id").alias("order_release_id"),
                              F.col(" created on ").alias("raw"),
                              DT.parse_date_default(F.col(" created on "), "created_on", _run_ts())
                              .alias("created_on"),
                              DT.parse_date_default(F.col(" created on "), "packed_on", _run_ts())
                              .alias("packed_on")))


@register("date_null")
def q_date_null(spark, sf):
    raw = _raw(spark, sf)
    return present(raw.select(F.col("order release id").alias("order_release_id"),
                              F.col(" created on ").alias("raw"),
                              DT.parse_date_null(F.col(" created on "), _run_ts()).alias("created_on")))


# --- fixed values: spellings of a date that users type, by order key -------------------
DATE_SPELLINGS = ["M/d/yyyy", "MM/dd/yy", "dd-MMM-yyyy", "MMM d, yyyy", "dd-MM-yy", "dd-MM-yyyy", "yyyy/MM/dd", "dd/MM/yyyy",
                  "d MMMM yyyy", "M/d/yyyy H:mm:ss"]
# --- end fixed values ---------------------------------------------------------------------


@register("date_spellings")
def q_date_spellings(spark, sf):
    """P5-P7 on spellings that only the generic parse reads."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    created, n = F.col("o_orderdate").cast("timestamp"), len(DATE_SPELLINGS)
    raw = F.lit("not a date")
    for i, layout in enumerate(DATE_SPELLINGS):
        raw = F.when(F.col("o_orderkey") % (n + 1) == i, F.date_format(created, layout)).otherwise(raw)
    o = o.select(F.col("o_orderkey").cast("string").alias("order_release_id"), raw.alias("raw"))
    null = DT.parse_date_null(F.col("raw"), _run_ts())
    return present(o.select("order_release_id", "raw", DT.parse_date_default(F.col("raw"), "created_on", _run_ts()).alias("p5"),
                            null.alias("p6"), DT.parse_date_coerce(F.col("raw")).alias("p7"), DT.unread(F.col("raw"), null).alias("unread")))


# --- fixed values: layouts of the free-form date query (the oracle writes the same texts) ----
FREE_FORM = ["EEE, dd MMM yyyy HH:mm:ss 'GMT'", "EEEE, MMMM d, yyyy h:mm:ss a", "d MMMM yyyy, HH:mm:ss", "MMM d yyyy hh:mm:ss.000 a", "yyyy MMM d HH:mm:ss'Z'",
             "EEE d-MMM-yyyy H:m:s", "MMMM d, yyyy HH:mm:ss '+0000'", "MM/dd/yyyy hh:mm:ss a"]
# --- end fixed values ------------------------------------------------------------------------


@register("date_grammar")
def q_date_grammar(spark, sf):
    """P5-P7 on free-form dates: weekdays, month names, halves of the day,
    zones, fractions; every ninth text is no date."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") * 37 % 86400)
    n, raw = len(FREE_FORM), F.concat(F.lit("week "), F.col("o_orderkey").cast("string"))
    for i, layout in enumerate(FREE_FORM):
        raw = F.when(F.col("o_orderkey") % (n + 1) == i, F.date_format(at, layout)).otherwise(raw)
    texts = o.select(F.col("o_orderkey").cast("string").alias("order_release_id"), raw.alias("raw"))
    return present(texts.select("order_release_id", "raw", DT.parse_date_default(F.col("raw"), "created_on", _run_ts()).alias("p5"),
                                DT.parse_date_null(F.col("raw"), _run_ts()).alias("p6"), DT.parse_date_coerce(F.col("raw")).alias("p7")))


@register("numeric_spellings")
def q_numeric_spellings(spark, sf):
    """P7-P9 on texts that a plain cast would misread, and on long amounts."""
    ln = spark.read.parquet(f"{sf}/lineitem.parquet")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    k = F.col("l_orderkey") % 6
    raw = (F.when(k == 0, F.concat(F.floor(price).cast("string"), F.lit("d"))).when(k == 1, F.concat((F.col("l_linenumber") + 1).cast("string"), F.lit("e3")))
           .when(k == 2, F.concat(F.lit("12345678901"), F.lpad(F.col("l_partkey").cast("string"), 6, "0"), F.lit(".25")))
           .when(k == 3, F.concat(F.col("l_linenumber").cast("string"), F.lit("F"))).when(k == 4, F.concat(F.lit("-"), price.cast("string"))).otherwise(F.lit("1_000")))
    ln = ln.select(F.col("l_orderkey").cast("string").alias("order_release_id"), raw.alias("raw"))
    text = lambda c: c.cast("string")  # noqa: E731 - exact digits, not doubles
    return ln.select("order_release_id", "raw", text(NU.parse_number_default(F.col("raw"), S.FLOAT)).alias("p8"),
                     text(NU.parse_number_null(F.col("raw"), S.FLOAT)).alias("p9"), text(NU.parse_number_coerce(F.col("raw"), S.FLOAT)).alias("p7"),
                     text(NU.parse_number_default(F.col("raw"), S.INTEGER)).alias("p8_int"))


@register("numeric_default")
def q_numeric_default(spark, sf):
    raw, v = _raw(spark, sf), F.col("final amount")
    return present(raw.select(F.col("order release id").alias("order_release_id"), v.alias("raw"),
                              NU.parse_number_default(v, S.FLOAT).alias("amount"),
                              NU.parse_number_default(v, S.INTEGER).alias("amount_int"),
                              NU.parse_number_default(v, S.FLOAT, 0.0, 100000.0).alias("amount_clamped")))


@register("numeric_null")
def q_numeric_null(spark, sf):
    raw, v = _raw(spark, sf), F.col("final amount")
    return present(raw.select(F.col("order release id").alias("order_release_id"), v.alias("raw"),
                              NU.parse_number_null(v, S.FLOAT).alias("amount"),
                              # nullable integer shown as double: pandas reads a
                              # BIGINT with NULLs differently per engine
                              NU.parse_number_null(v, S.INTEGER).cast("double").alias("amount_int")))


@register("repair_types")
def q_repair_types(spark, sf):
    return present(_clean(spark, sf, "orders", "repair").df)


@register("bool_clean")
def q_bool_clean(spark, sf):
    raw, v = _raw(spark, sf), F.col("flag")
    return raw.select(F.col("order release id").alias("order_release_id"), v.alias("raw"),
                      TX.bool_default(v).alias("flag_default"), TX.bool_utils(v).alias("flag_reader"),
                      TX.bool_repair(v).alias("flag_repair"))


@register("string_clean")
def q_string_clean(spark, sf):
    raw, v = _raw(spark, sf), F.col("seller sku code")
    return raw.select(F.col("order release id").alias("order_release_id"), v.alias("raw"),
                      TX.string_clean(v, STRING_MAX_LENGTH, STRING_PATTERN).alias("sku"))


@register("gst_check")
def q_gst_check(spark, sf):
    raw, v = _raw(spark, sf), F.col("gst_number")
    return raw.select(F.col("order release id").alias("order_release_id"), v.alias("raw"),
                      TX.gst_check(v).alias("gst_number"))


@register("pincode_check")
def q_pincode_check(spark, sf):
    raw, v = _raw(spark, sf), F.col("zipcode")
    return raw.select(F.col("order release id").alias("order_release_id"), v.alias("raw"),
                      TX.pincode_check(v).alias("zipcode"))


@register("convert_table")
def q_convert_table(spark, sf):
    return present(_clean(spark, sf, "orders", "null").df)


@register("validate_table")
def q_validate_table(spark, sf):
    return present(_clean(spark, sf, "orders", "default").df)


@register("required_nulls")
def q_required_nulls(spark, sf):
    return CL.required_nulls(_clean(spark, sf, "orders", "default"))


@register("validation_stats")
def q_validation_stats(spark, sf):
    return CL.validation_stats([_clean(spark, sf, t) for t in ("orders", "returns", "settlement")])


@register("issue_groups")
def q_issue_groups(spark, sf):
    return CL.issue_groups([_clean(spark, sf, t) for t in ("orders", "returns", "settlement")])


@register("money_text")
def q_money_text(spark, sf):
    a = _a(spark, sf)
    by_brand = (a.where(F.col("brand").isNotNull()).groupBy("brand")
                 .agg(M.money_sum(F.col("order_settlement")).alias("value"),
                      M.pct(F.count_if(F.col("status") == S.DELIVERED_SETTLED), F.count("*")).alias("rate")))
    return by_brand.select("brand", TX.currency_text(F.col("value")).alias("settlement_value_text"),
                           TX.percent_text(F.col("rate")).alias("settlement_rate_text"))


# --- merge (W1-W3, J8) ---------------------------------------------------------------

MERGE_PAYLOAD = ["order_release_id", "order_line_id", "l_partkey", "l_suppkey", "l_quantity",
                 "l_returnflag", "l_linestatus", "price", "disc", "tax", "upload_timestamp"]


@register("merge_latest")
def q_merge_latest(spark, sf):
    master, incoming = tv.merge_inputs(spark, sf)
    return present(MG.merge_latest(master, incoming).select(*MERGE_PAYLOAD))


def _without_some_lines(df):
    """Every seventh part's rows lose their line id: a missing key part."""
    return df.withColumn("order_line_id", F.when(F.col("l_partkey") % 7 != 0, F.col("order_line_id")))


@register("merge_latest_bucketed")
def q_merge_latest_bucketed(spark, sf):
    """W1 into a bucketed master, with missing key parts on both sides."""
    from settlekit import sinks as SK
    from settlekit.session import checkpoint_dir
    master, incoming = (_without_some_lines(df) for df in tv.merge_inputs(spark, sf))

    def build():
        import uuid
        path = f"{checkpoint_dir(spark).rstrip('/')}/bucketed/{uuid.uuid4().hex}"
        # the master holds one row per key, as a master does
        SK.write_version(MG.merge_latest(master.limit(0), master), path, BATCH_BUCKETS)
        return path
    stored = SK.read_version(spark, _memo(spark, sf, "bucketed_master", build))
    return present(MG.merge_latest_bucketed(stored, incoming, BATCH_BUCKETS).select(*MERGE_PAYLOAD))


@register("duplicate_keys")
def q_duplicate_keys(spark, sf):
    _, incoming = tv.merge_inputs(spark, sf)
    return present(MG.duplicate_keys(incoming).select(
        "order_release_id", "order_line_id", "l_partkey", "upload_timestamp", "message"))


@register("merge_stats")
def q_merge_stats(spark, sf):
    master, incoming = tv.merge_inputs(spark, sf)
    return MG.merge_stats(master, incoming)


@register("remove_duplicates")
def q_remove_duplicates(spark, sf):
    master, incoming = tv.merge_inputs(spark, sf)
    return present(MG.remove_duplicates(incoming, master, "order_release_id").select(*MERGE_PAYLOAD))


# --- data quality (J6, J7, A23-A28, A31) ---------------------------------------------------
# --- fixed values: month checked by the registered month summary ----------------------
EXISTING_YEAR, EXISTING_MONTH = 1996, 3
# --- end fixed values ---------------------------------------------------------------------


def _tables(spark, sf):
    o, r, s = tv.inputs(spark, sf)
    return {"orders": tv.misspelt_ids(o), "returns": r, "settlements": s}


def _raw_tables(spark, sf):
    return {"orders": tv.raw_orders_v(spark, sf).select(F.col("final amount").alias("final_amount")),
            "returns": tv.raw_returns_v(spark, sf), "settlements": tv.raw_settlement_v(spark, sf)}


RAW_NUMERIC_FIELDS = ["final_amount", "customer_paid_amount", "total_actual_settlement"]


def _quality_parts(spark, sf):
    return _memo(spark, sf, "quality", lambda: _build_quality_parts(spark, sf))


def _build_quality_parts(spark, sf):
    tables = _tables(spark, sf)
    # both are tiny (one row per column / per failing check): kept once per run
    comp = QA.completeness(tables).persist()
    errors = QA.validation_errors(tables, _raw_tables(spark, sf), RAW_NUMERIC_FIELDS).persist()
    o_part = tv.orders_partial_v(spark, sf, tv.FEW_MISSING)
    return comp, errors, QA.orphans(tables["returns"], o_part), QA.orphans(tables["settlements"], o_part)


@register("completeness")
def q_completeness(spark, sf):
    return QA.completeness(_tables(spark, sf))


@register("orphan_returns")
def q_orphan_returns(spark, sf):
    return present(QA.orphans(tv.returns_v(spark, sf), tv.orders_partial_v(spark, sf, tv.TENTH_MISSING)).drop("_ord"))


@register("orphan_settlements")
def q_orphan_settlements(spark, sf):
    return present(QA.orphans(tv.settlement_v(spark, sf), tv.orders_partial_v(spark, sf, tv.TENTH_MISSING)).drop("_ord"))


@register("invalid_ids")
def q_invalid_ids(spark, sf):
    return QA.invalid_ids(_tables(spark, sf))


@register("invalid_numerics")
def q_invalid_numerics(spark, sf):
    return QA.invalid_numerics(_raw_tables(spark, sf), RAW_NUMERIC_FIELDS)


@register("validation_errors")
def q_validation_errors(spark, sf):
    return _quality_parts(spark, sf)[1]


@register("quality_score")
def q_quality_score(spark, sf):
    return QA.quality_score(*_quality_parts(spark, sf))


@register("quality_recommendations")
def q_quality_recommendations(spark, sf):
    return QA.quality_recommendations(*_quality_parts(spark, sf))


@register("existing_month")
def q_existing_month(spark, sf):
    o, r, s = tv.inputs(spark, sf)
    return QA.existing_month({"orders": (o, "created_on", "final_amount"),
                              "returns": (r, "return_date", "total_actual_settlement"),
                              "settlement": (s, "return_date", "total_actual_settlement")},
                             EXISTING_YEAR, EXISTING_MONTH)


# --- reports (R1-R5) -----------------------------------------------------------------------


@register("recon_report")
def q_recon_report(spark, sf):
    run, np_, rs = _tracking(spark, sf)
    return RP.recon_report(run.analysis, np_, rs, run.run_month)


@register("recon_report_active")
def q_recon_report_active(spark, sf):
    run, np_, rs = _tracking(spark, sf)
    return RP.recon_report(run.analysis, np_, rs, run.run_month, denominator="active")


@register("recon_sections")
def q_recon_sections(spark, sf):
    return RP.recon_sections(_a(spark, sf))


@register("financial_report")
def q_financial_report(spark, sf):
    return RP.financial_report(_a(spark, sf))


@register("dq_report")
def q_dq_report(spark, sf):
    return RP.dq_report(_a(spark, sf), _quality_parts(spark, sf)[1])


@register("report_by_type")
def q_report_by_type(spark, sf):
    a = _a(spark, sf)
    return (RP.report_by_type(a, "reconciliation", DATE_FROM, DATE_TO).withColumn("report", F.lit("reconciliation"))
            .unionByName(RP.report_by_type(a, "financial", DATE_FROM, DATE_TO)
                         .withColumn("report", F.lit("financial")))
            .unionByName(RP.report_by_type(a, "data_quality", DATE_FROM, DATE_TO, _quality_parts(spark, sf)[1])
                         .withColumn("report", F.lit("data_quality"))))


# --- sources (S1-S4, S7, P17) ----------------------------------------------------------------


def _scan_orders(spark, sf):
    paths = EX.materialize(spark, sf, "orders")
    return CSV.scan_tolerant(spark, paths["orders"], quote=None)


@register("scan_tolerant")
def q_scan_tolerant(spark, sf):
    rows, _ = _scan_orders(spark, sf)
    return rows.drop("_source_file", "_ord")


@register("bad_lines")
def q_bad_lines(spark, sf):
    _, bad = _scan_orders(spark, sf)
    return bad.select("first_field", "message", "value")


@register("scan_quoted")
def q_scan_quoted(spark, sf):
    """Plain nested files with quoted line breaks and doubled quotes, found by
    the landing listing."""
    listing = CSV.list_landing(spark, EX.materialize_quoted(spark, sf))
    found = listing.where(F.col("file_type") == "orders").select("path").collect()
    rows, _ = CSV.scan_tolerant(spark, sorted(r.path for r in found))
    return rows.drop("_source_file", "_ord")


@register("scan_unbalanced_quote")
def q_scan_unbalanced_quote(spark, sf):
    """Quoted fields over several lines, and brands whose opening quote never
    closes: no other row is lost or joined."""
    rows, _ = CSV.scan_tolerant(spark, EX.materialize_unbalanced(spark, sf, "comma")["comma"])
    return rows.drop("_source_file", "_ord")


@register("scan_unbalanced_tab")
def q_scan_unbalanced_tab(spark, sf):
    rows, _ = CSV.scan_tolerant(spark, EX.materialize_unbalanced(spark, sf, "tab")["tab"])
    return rows.drop("_source_file", "_ord")


@register("stray_quotes")
def q_stray_quotes(spark, sf):
    """The issue rows of both."""
    paths = EX.materialize_unbalanced(spark, sf, "comma", "tab")
    found = [CSV.stray_quotes(*CSV.scan_raw(spark, paths[k])).select("first_field", "message", "value") for k in ("comma", "tab")]
    return found[0].unionByName(found[1])


@register("scan_mixed_quoting")
def q_scan_mixed_quoting(spark, sf):
    """A group of files of one header, some healthy, some unbalanced: the
    healthy ones are still read by the CSV source."""
    paths = EX.materialize_unbalanced(spark, sf, "plain", "comma")
    rows, _ = CSV.scan_tolerant(spark, [paths["plain"], paths["comma"]])
    return rows.groupBy(F.col("order release id"), F.col("order line id"), F.col("brand")).agg(F.count("*").alias("n"))


@register("load_stats")
def q_load_stats(spark, sf):
    rows, _ = _scan_orders(spark, sf)
    return CL.clean(rows, "orders", "default", tv.RUN_TS).stats


@register("cell_issues")
def q_cell_issues(spark, sf):
    """Every value of the orders extract that cleansing replaced, by
    order, with the number of its row in the file checked against the rows."""
    rows, _ = _scan_orders(spark, sf)
    found = CL.cell_issues(rows, "orders", "default", tv.RUN_TS, ("order_release_id",))
    numbered = CL.row_numbers(CL.rename_columns(rows, "orders")).select(
        F.col("_source_file").alias("f"), F.col("row_index").alias("i"), F.col("order_release_id").alias("at_row"))
    joined = found.join(numbered, (F.col("_source_file") == F.col("f")) & (F.col("row_index") == F.col("i")))
    return joined.select("file_type", "severity", "at_row", "column", "message", "value")


def _file_names(spark, sf):
    """Names an upload could have, one per order: type, month, upper case,
    without a period, of an unknown type."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("orders", "Returns", "settlement", "notes", "my-ORDERS")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    period = F.when(F.col("o_orderkey") % 7 == 0, F.lit("")).otherwise(F.date_format("o_orderdate", "-MM-yyyy"))
    return o.select(F.concat(kind, period, F.lit(".csv")).alias("extract"))


@register("route_files")
def q_route_files(spark, sf):
    names = _file_names(spark, sf)
    return names.select("extract", CSV.file_type_of(F.col("extract")).alias("file_type"), CSV.file_period(F.col("extract")).alias("period"))


@register("file_period")
def q_file_period(spark, sf):
    names = _file_names(spark, sf).where(CSV.file_type_of(F.col("extract")).isNotNull())
    return names.groupBy(CSV.file_period(F.col("extract")).alias("period")).agg(F.count("*").alias("files"))


@register("csv_repair")
def q_csv_repair(spark, sf):
    paths = EX.materialize(spark, sf, "repair")
    return CSV.read_repaired(spark, paths["repair"])


@register("repair_job")
def q_repair_job(spark, sf):
    """Repaired read -> repair coercion -> CSV written (K7) -> read back."""
    from settlekit import sinks as SK
    paths = EX.materialize(spark, sf, "repair")
    fixed = CL.clean(CSV.read_repaired(spark, paths["repair"]), "orders", "repair", tv.RUN_TS).df
    out = f"{paths['root']}/repaired/orders"
    SK.write_repaired_csv(fixed, out)
    return spark.read.option("header", True).option("escape", "\\").option("multiLine", True).csv(out)


# --- streaming (S8) ----------------------------------------------------------------------------

_STREAMED: dict = {}


def _streamed(spark, sf, landing, files_per_batch=None):
    key = (spark.sparkContext.applicationId, sf, landing, files_per_batch)
    if key not in _STREAMED:
        p = EX.materialize_arrivals(spark, sf, landing)
        warehouse = f"{p['root']}/streamed-{landing}-{files_per_batch or 0}"
        _STREAMED[key] = INC.incremental_merge(spark, p[landing], "returns", warehouse, f"{warehouse}/_checkpoint",
                                               tv.RUN_TS, files_per_batch=files_per_batch)
    return _STREAMED[key]


@register("incremental_merge")
def q_incremental_merge(spark, sf):
    """Returns extract landed in two arrivals, ingested by one stream run."""
    return present(_streamed(spark, sf, "stream"))


@register("incremental_merge_batches")
def q_incremental_merge_batches(spark, sf):
    """Same, four files per micro-batch: the master is upserted batch by batch."""
    return present(_streamed(spark, sf, "stream", 4))


@register("incremental_mixed_headers")
def q_incremental_mixed_headers(spark, sf):
    """Plain files whose columns stand in different orders, one of them nested
    and tab-separated: columns are matched by name."""
    return present(_streamed(spark, sf, "mixed"))


@register("incremental_two_checkpoints")
def q_incremental_two_checkpoints(spark, sf):
    """Two landing folders with a checkpoint each feed one warehouse: both
    start with batch 0, and neither is taken for a replay of the other."""
    def build():
        p = EX.materialize_arrivals(spark, sf, "first", "second")
        warehouse = f"{p['root']}/streamed-two"
        for landing in ("first", "second"):
            out = INC.incremental_merge(spark, p[landing], "returns", warehouse, f"{warehouse}/_checkpoint-{landing}", tv.RUN_TS)
        return out
    return present(_memo(spark, sf, "two_checkpoints", build))


def _upserted(spark, sf):
    """Two upserts into a master copied on write, and a snapshot between them."""
    def build():
        import uuid

        from settlekit import masters as MS
        from settlekit import sinks as SK
        from settlekit.session import checkpoint_dir
        root = f"{checkpoint_dir(spark).rstrip('/')}/upserted/{uuid.uuid4().hex}"
        master, incoming = (_without_some_lines(df) for df in tv.merge_inputs(spark, sf))
        MS.upsert(master, root, "lines", buckets=BATCH_BUCKETS)
        taken = SK.snapshot_versions(spark, root, ["lines"], f"{root}/snapshots", tv.RUN_TS)
        return MS.upsert(incoming, root, "lines"), taken
    return _memo(spark, sf, "upserted", build)


@register("master_upserts")
def q_master_upserts(spark, sf):
    """The master after a second batch rewrote the buckets it touched."""
    from settlekit import sinks as SK
    return present(SK.read_version(spark, _upserted(spark, sf)[0]).select(*MERGE_PAYLOAD))


@register("snapshot_restore")
def q_snapshot_restore(spark, sf):
    """K6: the same master as of the snapshot between the two batches."""
    from settlekit import sinks as SK
    return present(SK.read_snapshot(spark, _upserted(spark, sf)[1], "lines").select(*MERGE_PAYLOAD))


# --- the batch run (entry point of the reference's command line) ------------------------------------

_BATCHES: dict = {}
BATCH_BUCKETS = 8   # masters bucketed by order key (the analysis join skips the orders shuffle)


@register("batch_run")
def q_batch_run(spark, sf):
    """Landing extracts -> cleansing -> master upserts -> analysis -> report,
    all written to a fresh warehouse folder; returns the run summary."""
    return _batch(spark, sf)[0].summary


def _batch(spark, sf):
    """(result, warehouse folder) of the session's batch run."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BATCHES:
        p = EX.materialize(spark, sf, "orders", "returns", "settlement", "notes")
        warehouse = f"{p['root']}/warehouse"
        _BATCHES[key] = BT.run_batch(spark, p["landing"], warehouse, tv.RUN_TS, buckets=BATCH_BUCKETS, size_partitions=True), warehouse
    return _BATCHES[key]


@register("sink_master")
def q_sink_master(spark, sf):
    """K1 read back: the orders master that the batch run wrote."""
    orders = BT._master(spark, _batch(spark, sf)[1], "orders")
    return present(orders.select(*[s.name for s in S.SPECS["orders"]]))


@register("sink_anomalies")
def q_sink_anomalies(spark, sf):
    """K3 read back."""
    return present(spark.read.parquet(_batch(spark, sf)[0].paths["anomalies"]))


@register("sink_issues")
def q_sink_issues(spark, sf):
    """K5 read back: the JSON issues of the batch run, all entities. Row numbers
    of cells follow the files as Spark wrote them, so they stand as -2 here
    (``cell_issues`` checks them), those of whole lines as -1."""
    schema = "file_type string, severity string, row_index long, column string, message string, value string"
    return spark.read.schema(schema).json(_batch(spark, sf)[0].paths["issues"]).withColumn("row_index", F.when(
        F.startswith("message", F.lit("Invalid ")), -2).otherwise(F.coalesce("row_index", F.lit(-1))).cast("long"))


@register("incremental_run")
def q_incremental_run(spark, sf):
    """S8 end to end: every landed extract streamed (availableNow, one
    micro-batch per entity and run) into the masters, then the analysis
    rebuilt; returns the run summary."""
    def build():
        p = EX.materialize(spark, sf, "orders", "returns", "settlement", "notes")
        root = f"{p['root']}/incremental"
        a, _prev = INC.incremental_run(spark, p["landing"], root, f"{root}/_checkpoints", tv.RUN_TS)
        return M.run_summary(a)
    return _memo(spark, sf, "incremental_run", build)
