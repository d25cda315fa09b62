"""The analysis table: one row per order row with status, P/L and changes.

Plan shape (all keyed by ``order_release_id``)::

    returns     -> (key, r=struct(order, payload))  \
    settlements -> (key, s=struct(order, payload))   +-> union -> one partial
    previous    -> (key, v=struct(order, status))   /    aggregate: min(r), min(s), max(v)
                                                         -> one row per order
    orders  LEFT JOIN  that  (one join; hot order keys salted, operators.skew)

The three related tables are reduced to one row per order by a single
aggregate (combined map-side, one shuffle), so the join partner of
``orders`` has unique keys. An order key holding a large share of the
``orders`` rows is spread over several tasks by selective salting; without
hot keys the join is a plain sort-merge (or AQE broadcast) join.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlekit import schema as S
from settlekit.functions import status as X
from settlekit.functions.dates import ts_lit
from settlekit.operators.skew import HOT_KEY_ROWS, hot_keys, left_join_unique

KEY = "order_release_id"
ORD = "_ord"

RETURN_PAYLOAD = ["return_type", "total_actual_settlement"]
SETTLEMENT_PAYLOAD = ["total_actual_settlement", "total_commission",
                      "total_logistics_deduction", "tcs_amount", "tds_amount"]

ANALYSIS_COLUMNS = ["status", "profit_loss", "return_settlement", "order_settlement",
                    "status_changed_this_run", "settlement_update_run_timestamp",
                    "net_revenue", "commission_cost", "logistics_cost", "tax_deductions",
                    "net_profit_loss", "settlement_month", "status_group", "previous_status"]


def file_order(df: DataFrame) -> F.Column:
    """Row order of a master table as the reference writes it: sorted by
    upload time, newest first, missing times last; then line id and date.
    ``min`` of this struct is the first row, ``max`` the last."""
    parts = []
    if "upload_timestamp" in df.columns:
        newest_first = F.coalesce(-F.unix_micros(F.col("upload_timestamp")), F.lit(2 ** 63 - 1))
        parts.append(newest_first.alias("t"))
    parts += [F.col(c) for c in ("order_line_id", "return_date") if c in df.columns]
    return F.struct(*parts)


def _ordering(df: DataFrame, order_col: str | None) -> F.Column:
    """Row order of a related table: the given column (a file / row ordinal),
    else the master file order."""
    if order_col and order_col in df.columns:
        return F.col(order_col)
    return file_order(df)


def first_per_order(df: DataFrame, payload: list[str], order_col: str | None = ORD,
                    alias: str = "first") -> DataFrame:
    """First related record per order.

    ``min(struct(order, payload))``: a partial aggregate (combined map-side);
    when the order is not unique the payload breaks the tie, so the winner
    never depends on partitioning. Missing payload columns are NULL
    (optional settlement columns)."""
    fields = [(F.col(c) if c in df.columns else F.lit(None).cast(S.MONEY)).alias(c) for c in payload]
    best = F.min(F.struct(_ordering(df, order_col).alias("o"), F.struct(*fields).alias("p")))
    return df.groupBy(KEY).agg(best.getField("p").alias(alias))


def previous_status(prev: DataFrame, order_cols: list[str] | None = None) -> DataFrame:
    """Status per order in the previous run; duplicates: the last row (in
    the master file order) wins."""
    order = (F.struct(*[F.col(c) for c in order_cols if c in prev.columns]) if order_cols
             else F.struct(file_order(prev).alias("f"), F.col("status")))
    last = F.max(F.struct(order.alias("o"), F.col("status").alias("s")))
    return (prev.where(F.col(KEY).isNotNull())
                .groupBy(KEY)
                .agg(last.getField("s").alias("previous_status")))


def related_per_order(returns: DataFrame, settlements: DataFrame, previous: DataFrame | None = None,
                      order_col: str | None = ORD, prev_order_cols: list[str] | None = None) -> DataFrame:
    """First return, first settlement and previous status per order, from
    one aggregate over the tagged union of the three tables."""
    def value(df: DataFrame, payload: list[str], oc: str | None) -> F.Column:
        fields = [(F.col(c) if c in df.columns else F.lit(None).cast(S.MONEY)).alias(c) for c in payload]
        return F.struct(_ordering(df, oc).alias("o"), F.struct(*fields).alias("p"))

    r_val = value(returns, RETURN_PAYLOAD, order_col)
    s_val = value(settlements, SETTLEMENT_PAYLOAD, order_col)
    r_type = returns.select(r_val).schema[0].dataType
    s_type = settlements.select(s_val).schema[0].dataType
    branches = [returns.select(KEY, r_val.alias("r"), F.lit(None).cast(s_type).alias("s")),
                settlements.select(KEY, F.lit(None).cast(r_type).alias("r"), s_val.alias("s"))]
    if previous is not None:
        order = (F.struct(*[F.col(c) for c in prev_order_cols if c in previous.columns]) if prev_order_cols
                 else file_order(previous))
        v_val = F.struct(order.alias("o"), F.col("status").alias("p"))
        v_type = previous.select(v_val).schema[0].dataType
        branches = [b.withColumn("v", F.lit(None).cast(v_type)) for b in branches]
        branches.append(previous.where(F.col(KEY).isNotNull()).select(
            KEY, F.lit(None).cast(r_type).alias("r"), F.lit(None).cast(s_type).alias("s"), v_val.alias("v")))
    u = branches[0]
    for b in branches[1:]:
        u = u.unionByName(b)
    aggs = [F.min("r").getField("p").alias("r"), F.min("s").getField("p").alias("s")]
    if previous is not None:
        aggs.append(F.max("v").getField("p").alias("previous_status"))
    else:
        aggs.append(F.lit(None).cast("string").alias("previous_status"))
    return u.groupBy(KEY).agg(*aggs)


def analyze(orders: DataFrame, returns: DataFrame, settlements: DataFrame,
            previous: DataFrame | None = None, run_ts: _dt.datetime | None = None,
            order_col: str | None = ORD, hot_key_rows: int = HOT_KEY_ROWS,
            order_counts: dict | None = None, apart: bool = False) -> DataFrame:
    """Classify every order row (C6). ``run_ts`` stamps changed rows.

    ``apart``: the tables are stored in buckets of the order key, so each is
    reduced and joined by itself, in place; one aggregate over all of them would
    have to shuffle them. (With a hot order they are shuffled.)

    Order keys with at least ``hot_key_rows`` rows are salted in the join
    (``operators.skew``); deciding whether any exists fetches one row, or
    nothing where ``order_counts`` (a master's stored heavy keys) tells."""
    run_ts = run_ts or _dt.datetime.now()
    if apart and order_counts is None and hot_keys(orders, KEY, hot_key_rows).isEmpty():
        a = orders
        for one in (first_per_order(returns, RETURN_PAYLOAD, order_col, "r"), first_per_order(settlements, SETTLEMENT_PAYLOAD, order_col, "s")):
            a = left_join_unique(a, one, KEY, None)
        a = (left_join_unique(a, previous_status(previous), KEY, None) if previous is not None
             else a.withColumn("previous_status", F.lit(None).cast("string")))
    else:
        rel = related_per_order(returns, settlements, previous, order_col)
        a = left_join_unique(orders, rel, KEY, hot_key_rows, counts=order_counts)

    has_r, has_s = F.col("r").isNotNull(), F.col("s").isNotNull()
    zero = F.lit(0).cast(S.MONEY)
    ret_amt = F.when(has_r, F.col("r.total_actual_settlement")).otherwise(zero)
    set_amt = F.when(has_s, F.col("s.total_actual_settlement")).otherwise(zero)
    status = X.order_status(F.col("order_status"), F.col("is_ship_rel"), has_r,
                            F.col("r.return_type"), has_s)
    changed = F.coalesce(F.col("previous_status").isNotNull()
                         & (F.col("previous_status") != F.col("status")), F.lit(False))
    month_derived = F.date_format(F.col("created_on"), "yyyy-MM")
    month = (F.coalesce(F.col("settlement_month"), month_derived)
             if "settlement_month" in orders.columns else month_derived)

    out = (a.withColumn("status", status)
            .withColumn("profit_loss",
                        X.profit_loss(F.col("order_status"), F.col("is_ship_rel"), set_amt, ret_amt)
                        .cast(S.MONEY))
            .withColumn("return_settlement", ret_amt)
            .withColumn("order_settlement", set_amt)
            .withColumn("status_changed_this_run", changed)
            .withColumn("settlement_update_run_timestamp", F.when(changed, ts_lit(run_ts)))
            .withColumn("net_revenue", F.col("s.total_actual_settlement"))
            .withColumn("commission_cost", F.col("s.total_commission"))
            .withColumn("logistics_cost", F.col("s.total_logistics_deduction"))
            .withColumn("tax_deductions", (F.col("s.tcs_amount") + F.col("s.tds_amount")).cast(S.MONEY))
            .withColumn("net_profit_loss", F.col("profit_loss"))
            .withColumn("settlement_month", month)
            .withColumn("status_group", X.status_group(F.col("status"))))
    base = [c for c in orders.columns if c not in ANALYSIS_COLUMNS]
    return out.select(*base, *ANALYSIS_COLUMNS)
