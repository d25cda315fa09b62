"""Data-quality checks over the master tables.

Completeness is one aggregate per table (``count(c)`` for every column in
a single scan, then an unpivot of that one row) — never one job per column.
Orphans are anti joins on the order key.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from settlekit.functions.dates import ts_lit
from settlekit.operators.metrics import _d, money_sum, pct
from settlekit.operators.skew import join_unique

ID_PATTERN = "^[A-Z0-9]+$"
NUMERIC_FIELDS = ["profit_loss", "commission", "logistics_cost"]
COMPLETENESS_THRESHOLD = 90.0


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def visible_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def completeness(tables: dict[str, DataFrame]) -> DataFrame:
    """Non-null share per column per table (0 when the table is empty)."""
    parts = []
    for name, df in tables.items():
        cols = visible_columns(df)
        one = df.agg(F.count("*").alias("_rows"), *[F.count(_c(c)).alias(f"_{i}") for i, c in enumerate(cols)])
        kv = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                                          F.col(f"_{i}").alias("non_null"))
                                 for i, c in enumerate(cols)])).alias("kv")
        parts.append(one.select(F.lit(name).alias("table"), kv, "_rows").select(
            "table", "kv.position", "kv.column",
            pct(F.col("kv.non_null"), F.col("_rows")).alias("completeness")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def orphans(child: DataFrame, orders: DataFrame, key: str = "order_release_id") -> DataFrame:
    """Child rows whose key has no order (NULL matches NULL).

    The order keys are de-duplicated first (partial aggregate), so the anti
    join's build side has one row per key; hot child keys are salted."""
    return join_unique(child, orders.select(key).distinct(), key, "left_anti", null_safe=True)


def invalid_ids(tables: dict[str, DataFrame], key: str = "order_release_id") -> DataFrame:
    """Ids not matching ``^[A-Z0-9]+$`` (missing counts as invalid)."""
    parts = [df.agg(F.count_if(~F.coalesce(F.col(key).rlike(ID_PATTERN), F.lit(False))).alias("invalid"))
               .select(F.lit(name).alias("table"), F.lit(key).alias("field"), "invalid")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def invalid_numerics(tables: dict[str, DataFrame], fields: list[str] | None = None) -> DataFrame:
    """Values present but not numeric, per table and field that exists."""
    fields = fields or NUMERIC_FIELDS
    parts = []
    for name, df in tables.items():
        present = [f for f in fields if f in df.columns]
        if not present:
            continue
        one = df.agg(*[F.count_if(_c(f).isNotNull() & _c(f).cast("string").try_cast("double").isNull())
                       .alias(f"_{i}") for i, f in enumerate(present)])
        parts.append(one.select(F.lit(name).alias("table"), F.explode(F.array(*[
            F.struct(F.lit(f).alias("field"), F.col(f"_{i}").alias("invalid"))
            for i, f in enumerate(present)])).alias("kv")).select("table", "kv.field", "kv.invalid"))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validation_errors(tables: dict[str, DataFrame], numeric_tables: dict[str, DataFrame] | None = None,
                      fields: list[str] | None = None) -> DataFrame:
    """Error rows (file, field, message) for every failing id / numeric check."""
    ids = (invalid_ids(tables).where(F.col("invalid") > 0)
           .select(F.col("table").alias("file"), "field",
                   F.format_string("Found %d invalid order IDs", F.col("invalid")).alias("message")))
    nums = invalid_numerics(numeric_tables if numeric_tables is not None else tables, fields)
    if nums is None:
        return ids
    nums = (nums.where(F.col("invalid") > 0)
            .select(F.col("table").alias("file"), "field",
                    F.format_string("Found %d invalid numeric values", F.col("invalid")).alias("message")))
    return ids.unionByName(nums)


def quality_score(comp: DataFrame, errors: DataFrame, orphan_returns: DataFrame,
                  orphan_settlements: DataFrame) -> DataFrame:
    """clamp(mean of per-table mean completeness - 5/error - 2/orphan)."""
    per_table = comp.groupBy("table").agg(F.avg("completeness").alias("c"))
    n_err = errors.select(F.count("*")).scalar()
    n_orph = orphan_returns.select(F.count("*")).scalar() + orphan_settlements.select(F.count("*")).scalar()
    return (per_table.agg(F.avg("c").alias("avg_completeness"))
            .select("avg_completeness", n_err.alias("validation_errors"), n_orph.alias("orphaned_records"))
            .withColumn("quality_score",
                        F.greatest(F.lit(0.0), F.least(F.lit(100.0),
                                   F.col("avg_completeness") - F.col("validation_errors") * 5
                                   - F.col("orphaned_records") * 2))))


def quality_recommendations(comp: DataFrame, errors: DataFrame, orphan_returns: DataFrame,
                            orphan_settlements: DataFrame) -> DataFrame:
    """Recommendation texts, in the reference's order (ord, text)."""
    low = (comp.where(F.col("completeness") < COMPLETENESS_THRESHOLD)
           .groupBy("table")
           .agg(F.array_sort(F.collect_list(F.struct("position", "column"))).alias("cols"))
           .select(F.lit(1).alias("ord"), "table",
                   F.concat(F.lit("Improve data completeness for "), F.col("table"), F.lit(" fields: "),
                            F.array_join(F.transform("cols", lambda x: x["column"]), ", ")).alias("recommendation")))
    counts = (orphan_returns.agg(F.count("*").alias("n")).select(
                  F.lit(2).alias("ord"), F.lit("returns").alias("table"),
                  F.format_string("Investigate %d orphaned returns", F.col("n")).alias("recommendation"),
                  F.col("n"))
              .unionByName(orphan_settlements.agg(F.count("*").alias("n")).select(
                  F.lit(3).alias("ord"), F.lit("settlements").alias("table"),
                  F.format_string("Investigate %d orphaned settlements", F.col("n")).alias("recommendation"),
                  F.col("n")))
              .unionByName(errors.agg(F.count("*").alias("n")).select(
                  F.lit(4).alias("ord"), F.lit("").alias("table"),
                  F.format_string("Address %d validation errors", F.col("n")).alias("recommendation"),
                  F.col("n")))
              .where(F.col("n") > 0).drop("n"))
    return low.unionByName(counts)


def existing_month(tables: dict[str, tuple[DataFrame, str, str]], year: int, month: int) -> DataFrame:
    """Count, value and last date per table for one ``yyyy-MM`` month.

    ``tables``: name -> (frame, date column, value column). The month test
    is written as a timestamp range so the scan can prune by statistics."""
    lo = _dt.datetime(year, month, 1)
    hi = _dt.datetime(year + (month == 12), month % 12 + 1, 1)
    parts = []
    for name, (df, date_col, value_col) in tables.items():
        d = F.col(date_col)
        parts.append(df.where(d.isNotNull() & (d >= ts_lit(lo)) & (d < ts_lit(hi)))
                     .agg(F.count("*").alias("count"), _d(money_sum(F.col(value_col))).alias("total_value"),
                          F.max(d).alias("last_updated"))
                     .where(F.col("count") > 0)
                     .select(F.lit(name).alias("table"), "count", "total_value",
                             F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("last_updated")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
