"""Landing-folder extracts derived from the test tables.

The source operators read delimited files, so the tests write the raw
extracts (``testviews.raw_*``) as files first — with Spark, into the
session's shared checkpoint folder, once per session and scale folder, and
only those that a query reads:

* ``landing/orders-1996-03``      tab-separated, no quoting; a brand value of
  some orders carries a tab (a *long* record) or a line break (two *short*
  records), like a hand-edited export
* ``landing/returns-1996-03``     comma-separated, quoted
* ``landing/settlement-1996-03``  comma-separated, quoted
* ``landing/notes-1996-03``       a file of unknown type (routing skips it)
  (the first three as gzip part files: as plain text they are three times the
  tables that they come from)
* ``repair/orders``               comma-separated, quoted, brand values with
  line breaks inside quotes (input of the repair read)
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from settlekit.session import checkpoint_dir, input_bytes, without_old_shuffles
from settlekit.sources import testviews as tv

_DONE: dict = {}
_WRITTEN: set = set()

# --- fixed values: which orders get a broken brand value ---------------------------
LONG_EVERY, SHORT_EVERY, WRAP_EVERY = 101, 103, 107
PERIOD = "1996-03"
# --- end fixed values -------------------------------------------------------------------


def messy_orders(spark: SparkSession, sf_dir: str, keep: bool = True) -> DataFrame:
    raw = tv.raw_orders_v(spark, sf_dir, keep)
    k = F.col("order release id").try_cast("long")
    brand = (F.when(k % LONG_EVERY == 0, F.concat(F.col("brand"), F.lit("\textra")))
             .when(k % SHORT_EVERY == 0, F.concat(F.col("brand"), F.lit("\ntail")))
             .otherwise(F.col("brand")))
    return raw.withColumn("brand", brand)


def wrapped_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tv.raw_orders_v(spark, sf_dir)
    k = F.col("order release id").try_cast("long")
    return raw.withColumn("brand", F.when(k % WRAP_EVERY == 0, F.concat(F.col("brand"), F.lit("\nline, two")))
                          .otherwise(F.col("brand")))


def write_unquoted(df: DataFrame, path: str, sep: str, compression: str = "none") -> None:
    """Delimited text as it stands, without any quoting (Spark's CSV writer
    quotes a value holding the delimiter). Each part file starts with the header."""
    header = sep.join(df.columns)
    line = F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])

    def with_header(batches):
        import pandas as pd
        first = True
        for pdf in batches:
            if first:
                pdf = pd.concat([pd.DataFrame({"value": [header]}), pdf], ignore_index=True)
                first = False
            yield pdf

    df.select(line.alias("value")).mapInPandas(with_header, "value string").write.text(path, compression=compression)


EXTRACTS = ("orders", "returns", "settlement", "notes", "repair")


def _paths(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Where the extracts of this session and folder stand, written or not."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DONE:
        root = f"{checkpoint_dir(spark).rstrip('/')}/extracts/{uuid.uuid4().hex}"
        landing = f"{root}/landing"
        _DONE[key] = {
            "landing": landing,
            "orders": f"{landing}/orders-{PERIOD}",
            "returns": f"{landing}/returns-{PERIOD}",
            "settlement": f"{landing}/settlement-{PERIOD}",
            "notes": f"{landing}/notes-{PERIOD}",
            "repair": f"{root}/repair/orders",
            "unbalanced": f"{root}/unbalanced",
            **{k: f"{root}/{k}" for k in ("stream", "mixed", "first", "second", "quoted")},
            "root": root,
        }
    return _DONE[key]


def _once(spark: SparkSession, sf_dir: str, name: str, write) -> None:
    """Write one extract unless this session has written it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        write()
        _WRITTEN.add(key)


def materialize(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, str]:
    """Write the named extracts (all by default), each once per session;
    returns the paths."""
    paths = _paths(spark, sf_dir)
    writers = {
        "orders": lambda p: write_unquoted(messy_orders(spark, sf_dir, keep=False), p, "\t", "gzip"),
        "returns": lambda p: tv.raw_returns_v(spark, sf_dir).write.option("header", True).csv(p, compression="gzip"),
        "settlement": lambda p: tv.raw_settlement_v(spark, sf_dir).write.option("header", True).csv(p, compression="gzip"),
        "notes": lambda p: spark.read.parquet(f"{sf_dir}/region.parquet").select("r_name").write.text(p),
        "repair": lambda p: (wrapped_orders(spark, sf_dir).write.option("header", True).option("quote", '"')
                             .option("escape", '"').csv(p)),
    }
    for name in names or EXTRACTS:
        with tv.table_partitions(spark, sf_dir), without_old_shuffles(spark):
            _once(spark, sf_dir, name, lambda: writers[name](paths[name]))  # noqa: B023 - called at once
    return paths


#: Bytes of the table below one landed plain file, at most.
FILE_BYTES = 16 * 1024 * 1024


def land_files(df: DataFrame, path: str, source: str, **options) -> None:
    """Plain files, as uploads land them (not a folder of part files): ``path``,
    and beside it ``<path>-2.csv``, ``-3`` ... where the table ``source`` that
    the rows come from has more than ``FILE_BYTES``. A file is written by one
    task, so their number and not their size grows with the table."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    tmp = f"{path}.writing"
    files = max(1, -(-input_bytes(spark, source) // FILE_BYTES))
    # few input splits or cached partitions hold many rows: dealt anew where one file won't do
    (df.coalesce(1) if files == 1 else df.repartition(files)).write.options(header=True, quote='"', escape='"', **options).csv(tmp)
    written = jvm.org.apache.hadoop.fs.Path(tmp)
    fs = written.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted(f.getPath().toString() for f in fs.listStatus(written) if f.getPath().getName().startswith("part-"))
    stem = path.removesuffix(".csv")
    for i, part in enumerate(parts):
        fs.rename(jvm.org.apache.hadoop.fs.Path(part), jvm.org.apache.hadoop.fs.Path(path if i == 0 else f"{stem}-{i + 1}.csv"))
    fs.delete(written, True)


ARRIVALS = ("stream", "mixed", "first", "second")


def materialize_arrivals(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, str]:
    """Arrivals of the returns extract for the incremental (streaming) ingest,
    those named (all by default):
    ``stream`` two folders of part files (before / from the cut date);
    ``mixed`` plain files, one nested, whose columns stand in other orders;
    ``first`` and ``second`` plain files too, for two checkpoints."""
    paths = _paths(spark, sf_dir)
    raw = tv.raw_returns_v(spark, sf_dir)
    cut = F.col("upload_timestamp") < F.lit(tv.CUT_DATE)
    before, after = raw.where(cut), raw.where(~cut)
    lines = f"{sf_dir}/lineitem.parquet"

    def stream():
        before.write.option("header", True).csv(f"{paths['stream']}/returns-1998-06")
        after.write.option("header", True).csv(f"{paths['stream']}/returns-1998-07")

    def mixed():
        land_files(before, f"{paths['mixed']}/returns-06-1998.csv", lines)
        land_files(after.select(*reversed(raw.columns)), f"{paths['mixed']}/late/returns-07-1998.csv", lines, sep="\t")

    writers = {"stream": stream, "mixed": mixed,
               "first": lambda: land_files(before, f"{paths['first']}/returns-06-1998.csv", lines),
               "second": lambda: land_files(after, f"{paths['second']}/returns-07-1998.csv", lines)}
    for name in names or ARRIVALS:
        _once(spark, sf_dir, name, writers[name])
    return paths


def quoted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders extract with line breaks, commas and quotes inside brands."""
    raw = tv.raw_orders_v(spark, sf_dir)
    k = F.col("order release id").try_cast("long")
    return raw.withColumn("brand", F.when(k % 5 == 0, F.concat(F.col("brand"), F.lit('\nsay "hi", ok')))
                          .when(k % 5 == 1, F.concat(F.lit('"'), F.col("brand"), F.lit('"'))).otherwise(F.col("brand")))


def materialize_quoted(spark: SparkSession, sf_dir: str) -> str:
    """``quoted_orders`` as plain files in a nested landing folder."""
    root = _paths(spark, sf_dir)["quoted"]
    _once(spark, sf_dir, "quoted", lambda: land_files(
        quoted_orders(spark, sf_dir), f"{root}/2025/orders-01-2025.csv", f"{sf_dir}/orders.parquet"))
    return root


# --- fixed values: which orders get a brand with an opening quote that never closes ------------
STRAY_EVERY, STRAY_AT = 97, 3
# --- end fixed values -------------------------------------------------------------------------------


def unbalanced_orders(spark: SparkSession, sf_dir: str, sep: str) -> DataFrame:
    """The orders extract as text fields of a file: brands with line breaks,
    delimiters and quotes are quoted, and some begin with a stray quote."""
    raw = tv.raw_orders_v(spark, sf_dir)
    k = F.col("order release id").try_cast("long")
    wrapped = F.concat(F.lit('"'), F.col("brand"), F.lit(f'\nsay ""hi""{sep} ok"'))
    brand = (F.when(k % STRAY_EVERY == STRAY_AT, F.concat(F.lit('"5 inch '), F.col("brand")))
             .when(k % 5 == 0, wrapped).when(k % 5 == 1, F.concat(F.lit('"'), F.col("brand"), F.lit('"'))).otherwise(F.col("brand")))
    def field(c: str):
        v = F.col(f"`{c}`")
        return F.when(F.contains(v, F.lit(sep)), F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v).alias(c)

    return raw.select(*[brand.alias(c) if c == "brand" else field(c) for c in raw.columns])


def materialize_unbalanced(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, str]:
    """``comma`` and ``tab``: ``unbalanced_orders`` with each delimiter;
    ``plain``: the same orders, a healthy file of one line a record. Those
    named are written (all by default)."""
    root = _paths(spark, sf_dir)["unbalanced"]
    paths = {k: f"{root}/orders-{k}" for k in ("comma", "tab", "plain")}
    writers = {
        "comma": lambda: write_unquoted(unbalanced_orders(spark, sf_dir, ","), paths["comma"], ","),
        "tab": lambda: write_unquoted(unbalanced_orders(spark, sf_dir, "\t"), paths["tab"], "\t"),
        "plain": lambda: tv.raw_orders_v(spark, sf_dir).write.option("header", True).csv(paths["plain"]),
    }
    for name in names or paths:
        _once(spark, sf_dir, f"unbalanced-{name}", writers[name])
    return paths
