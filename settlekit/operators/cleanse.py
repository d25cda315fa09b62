"""Schema-driven cleansing of raw (all-text) extracts.

``clean(raw, file_type, policy, run_ts)`` is one projection over the raw
frame: header rename, missing-column fill and per-type coercion are all
column expressions, so the whole job is a single narrow stage (no shuffle)
followed by one aggregate for the statistics and the required-null counts.

Policies (one per reference code path):

* ``default`` — validation path: dates P5, numbers P8, booleans P10
  (validation spelling), strings kept as read; missing columns filled with
  typed defaults.
* ``null``    — reader path: dates P6, numbers P9, booleans P10 (reader
  spelling); missing columns stay missing and are reported.
* ``repair``  — repair path: every missing column filled (dates with the run
  time), dates / numbers coerced, booleans exact, NULL strings become ''.

In every policy the usual "missing" spellings of a delimited read (empty,
``NULL``, ``NA``, ``nan``, ``None``, ``n/a`` ...) are NULL before coercion.

Issues are a DataFrame (file_type, severity, row_index, column, message,
value); statistics another (file_type, total_rows, valid_rows,
invalid_rows). A row is valid when none of its required columns is NULL.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from settlekit import schema as S
from settlekit.functions import dates as D
from settlekit.functions import numbers as N
from settlekit.functions import text as X

# --- fixed values: texts a delimited read treats as missing --------------------
NA_SPELLINGS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# --- end fixed values ------------------------------------------------------------

ISSUE_SCHEMA = T.StructType([
    T.StructField("file_type", T.StringType()), T.StructField("severity", T.StringType()),
    T.StructField("row_index", T.LongType()), T.StructField("column", T.StringType()),
    T.StructField("message", T.StringType()), T.StructField("value", T.StringType()),
])


@dataclass
class CleanResult:
    df: DataFrame
    issues: DataFrame
    stats: DataFrame
    column_issues: list = None


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def rename_columns(raw: DataFrame, file_type: str) -> DataFrame:
    """Trim header names, then map raw headers to schema names."""
    aliases = S.header_aliases(file_type)
    cols = []
    for c in raw.columns:
        trimmed = c.strip()
        cols.append(_c(c).alias(aliases.get(trimmed, trimmed)))
    return raw.select(*cols)


def drop_empty_rows(raw: DataFrame) -> DataFrame:
    """Rows NULL in every column are dropped."""
    return raw.na.drop(how="all")


def _default_fill(spec: S.ColumnSpec, policy: str, run_ts: Column) -> Column:
    if spec.name == "upload_timestamp":
        return run_ts
    if spec.kind == S.DATE:
        return run_ts if policy == "repair" else F.lit(None).cast("timestamp")
    if spec.kind == S.INTEGER:
        return F.lit(0).cast("long")
    if spec.kind == S.FLOAT:
        return F.lit(0).cast(S.MONEY)
    if spec.kind == S.BOOLEAN:
        return F.lit(False)
    return F.lit("")


def missing_as_null(raw: Column) -> Column:
    """Texts that mean "missing" in an extract become NULL."""
    v = raw.cast("string")
    return F.when(~v.isin(NA_SPELLINGS), v)


def coerce(raw: Column, spec: S.ColumnSpec, policy: str, run_ts: Column) -> Column:
    """One cell expression per (type, policy), after ``missing_as_null``."""
    raw = missing_as_null(raw)
    if spec.kind == S.DATE:
        if policy == "default":
            return D.parse_date_default(raw, spec.name, run_ts)
        if policy == "null":
            return D.parse_date_null(raw, run_ts)
        return D.parse_date_coerce(raw)
    if spec.kind in (S.INTEGER, S.FLOAT):
        if policy == "default":
            return N.parse_number_default(raw, spec.kind)
        if policy == "null":
            return N.parse_number_null(raw, spec.kind)
        return N.parse_number_coerce(raw, spec.kind)
    if spec.kind == S.BOOLEAN:
        return {"default": X.bool_default, "null": X.bool_utils}.get(policy, X.bool_repair)(raw)
    if policy == "repair":
        return X.string_repair(raw)
    return raw          # strings are kept as read (no trimming: P11 is a separate check)


def clean(raw: DataFrame, file_type: str, policy: str = "default",
          run_ts: _dt.datetime | None = None) -> CleanResult:
    """Rename, fill, coerce and check one raw extract."""
    ts = D.ts_lit(run_ts or _dt.datetime.now())
    specs = S.SPECS[file_type]
    df = rename_columns(drop_empty_rows(raw), file_type)
    column_issues = []
    if "upload_timestamp" not in df.columns and policy != "null":
        column_issues.append(("warning", "upload_timestamp",
                              "Added missing upload_timestamp column with current timestamp"))
    present = set(df.columns)
    out = []
    for spec in specs:
        if spec.name in present:
            out.append(coerce(_c(spec.name), spec, policy, ts).alias(spec.name))
            continue
        if policy == "null":
            if spec.required:
                column_issues.append(("error", spec.name, f"Missing required column: {spec.name}"))
            continue
        if spec.name != "upload_timestamp":
            sev = "error" if spec.required and policy == "default" else "warning"
            msg = ("Missing required column" if sev == "error" else
                   "Added missing column with default value")
            column_issues.append((sev, spec.name, msg))
        out.append(_default_fill(spec, policy, ts).alias(spec.name))
    lineage = [_c(c) for c in df.columns if c.startswith("_")]
    cleaned = df.select(*out, *lineage)
    issues, stats = summarize(cleaned, file_type, column_issues)
    return CleanResult(cleaned, issues, stats, column_issues)


def summarize(cleaned: DataFrame, file_type: str,
              column_issues: list[tuple[str, str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Issues and statistics of a cleansed (typed) frame: one aggregate gives
    the row counts and the NULL count of every required column."""
    spark = cleaned.sparkSession
    required = [s.name for s in S.SPECS[file_type] if s.required and s.name in cleaned.columns]
    row_ok = F.lit(True)
    for r in required:
        row_ok = row_ok & _c(r).isNotNull()
    one = cleaned.agg(F.count("*").alias("total_rows"), F.count_if(row_ok).alias("valid_rows"),
                      *[F.count_if(_c(r).isNull()).alias(f"_n{i}") for i, r in enumerate(required)])
    stats = one.select(F.lit(file_type).alias("file_type"), "total_rows", "valid_rows",
                       (F.col("total_rows") - F.col("valid_rows")).alias("invalid_rows"))
    issues = spark.createDataFrame(
        [(file_type, sev, 0, col, msg, None) for sev, col, msg in (column_issues or [])], ISSUE_SCHEMA)
    if required:
        nulls = one.select(F.explode(F.array(*[
            F.struct(F.lit(r).alias("column"), F.col(f"_n{i}").alias("n")) for i, r in enumerate(required)
        ])).alias("kv")).where(F.col("kv.n") > 0).select(
            F.lit(file_type).alias("file_type"), F.lit("error").alias("severity"),
            F.lit(0).cast("long").alias("row_index"), F.col("kv.column").alias("column"),
            F.format_string("Column %s has %d null values but is required", F.col("kv.column"),
                            F.col("kv.n")).alias("message"),
            F.lit(None).cast("string").alias("value"))
        issues = issues.unionByName(nulls)
    return issues, stats


def replaced_cell(raw: Column, spec: S.ColumnSpec, policy: str, run_ts: Column) -> Column:
    """(column, message, value) of a cell whose text can't be read as its type,
    so that ``coerce`` puts something else in its place; else NULL."""
    v = missing_as_null(raw)
    if spec.kind == S.DATE:
        wrong, instead = D.unread_date(v, spec.name, policy, run_ts), "the run time" if policy == "default" else "NULL"
    elif spec.kind in (S.INTEGER, S.FLOAT):
        wrong, instead = N.unread_number(v, spec.kind, policy), "0" if policy == "default" else "NULL"
    elif spec.kind == S.BOOLEAN:
        wrong, instead = X.unread_bool(v), "false"
    else:
        wrong, instead = F.lit(False), ""
    return F.when(wrong, F.struct(F.lit(spec.name).alias("column"), F.lit(f"Invalid {spec.kind} value: read as {instead}").alias("message"),
                                  v.alias("value")))


def row_numbers(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``_source_file`` and ``_ord``) with ``row_index``, their
    dense number from 0 within the file.

    A split numbers its own rows; the rows of the splits before are added, from
    counts of one row a split. No task sees more than one split's rows."""
    split = [F.col("_source_file").alias("_f"), F.col("_ord.b").alias("_b"), F.shiftright(F.col("_ord.i"), 33).alias("_s")]
    placed = rows.select("*", *split)
    per_split = placed.groupBy("_f", "_b", "_s").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_f").orderBy("_b", "_s")) - F.col("_n")
    offsets = per_split.select(F.col("_f").alias("_f2"), F.col("_b").alias("_b2"), F.col("_s").alias("_s2"), before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_f", "_b", "_s").orderBy("_ord.i")) - 1
    # one row a split: the rows themselves stay where they are
    joined = placed.withColumn("_own", own).join(F.broadcast(offsets), F.col("_f").eqNullSafe(F.col("_f2")) & (F.col("_b") == F.col("_b2")) & (F.col("_s") == F.col("_s2")))
    return joined.withColumn("row_index", (F.col("_own") + F.col("_before")).cast("long")).select(*rows.columns, "row_index")


def cell_issues(rows: DataFrame, file_type: str, policy: str, run_ts: _dt.datetime, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every value that cleansing replaced, with its row in the file: the issue
    columns, ``_source_file`` and the cleansed columns named in ``carry``.

    ``rows`` are the rows of a scan. One narrow projection finds the issues of a
    row as an array; only rows' places and arrays go on to be numbered."""
    ts = D.ts_lit(run_ts)
    df = rename_columns(rows, file_type)
    specs = [s for s in S.SPECS[file_type] if s.name in df.columns]
    found = F.array_compact(F.array(*[replaced_cell(_c(s.name), s, policy, ts) for s in specs]))
    narrow = df.select("_source_file", "_ord", found.alias("_cells"), *[_c(c).cast("string").alias(c) for c in carry])
    return (row_numbers(narrow).where(F.size("_cells") > 0)
            .select("_source_file", F.lit(file_type).alias("file_type"), F.lit("warning").alias("severity"), "row_index",
                    F.explode("_cells").alias("c"), *carry)
            .select("file_type", "severity", "row_index", "c.column", "c.message", "c.value", "_source_file", *carry))


def required_nulls(result: CleanResult) -> DataFrame:
    """The required-null messages of a cleansing run."""
    return result.issues.where(F.col("message").contains("null values but is required"))


def validation_stats(results: list[CleanResult]) -> DataFrame:
    """Total / valid / invalid rows per file type."""
    out = results[0].stats
    for r in results[1:]:
        out = out.unionByName(r.stats)
    return (out.groupBy("file_type").agg(F.sum("total_rows").cast("long").alias("total_rows"),
                                         F.sum("valid_rows").cast("long").alias("valid_rows"),
                                         F.sum("invalid_rows").cast("long").alias("invalid_rows")))


def issue_groups(results: list[CleanResult]) -> DataFrame:
    """Issues counted per file type, severity and column."""
    out = results[0].issues
    for r in results[1:]:
        out = out.unionByName(r.issues)
    return out.groupBy("file_type", "severity", "column").agg(F.count("*").alias("count"))


def fill_missing(df: DataFrame, file_type: str, policy: str, run_ts: _dt.datetime) -> DataFrame:
    """P3a/P3b/P3c as a standalone step: add absent schema columns."""
    ts = D.ts_lit(run_ts)
    add = {}
    for spec in S.SPECS[file_type]:
        if spec.name in df.columns:
            continue
        if policy == "read" and not spec.required:
            continue
        fill = _default_fill(spec, "repair" if policy in ("read", "repair") else "default", ts)
        add[spec.name] = fill
    return df.withColumns(add) if add else df


def essential_projection(df: DataFrame, file_type: str) -> DataFrame:
    """The schema columns present (missing ones are reported by clean)."""
    return df.select(*[_c(s.name) for s in S.SPECS[file_type] if s.name in df.columns])
