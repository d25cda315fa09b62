"""Delimited extracts: tolerant scan, routing, file period, repair.

One distributed ``spark.read.csv`` per entity replaces the reference's
chunked, strategy-by-strategy pandas reads. Only the first line of one
file (the header) is looked at on the driver, to pick the delimiter. Files
whose quoted fields hold line breaks go through ``records``, split as well.

Bad lines: Spark's PERMISSIVE mode marks a record whose field count differs
from the header as corrupt. As in the reference reader, a *long* record (more
delimiters than the header) is skipped and reported, a *short* one is kept
with the missing fields NULL.
"""

from __future__ import annotations

import csv as _pycsv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from settlekit.sources import records

CORRUPT = "_corrupt_record"
FILE_TYPES = ("orders", "returns", "settlement")


def first_line(spark: SparkSession, path: str) -> str:
    """First line of a file, or of the first part file of a folder or glob
    (read through Hadoop's file system: works wherever Spark reads)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(p) or []
    files = [f.getPath() for st in found for f in (fs.listStatus(st.getPath()) if st.isDirectory() else [st])
             if not f.getPath().getName().startswith(("_", "."))]
    for f in sorted(files, key=lambda f: f.toString()):
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration()).getCodec(f)
        stream = codec.createInputStream(fs.open(f)) if codec else fs.open(f)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        line = reader.readLine()
        reader.close()
        if line is not None:
            return line.lstrip("\ufeff")
    return ""


def sniff(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """Delimiter and header names from the first line of the input (D6:
    a tab-or-comma decision from the header, never 'first read that works')."""
    line = first_line(spark, path)
    sep = "\t" if line.count("\t") >= max(1, line.count(",")) else ","
    names = next(_pycsv.reader(io.StringIO(line), delimiter=sep)) if line else []
    return sep, names


def _delimiters_outside_quotes(text: Column, sep: str) -> Column:
    bare = F.regexp_replace(text, '"[^"]*"', "")
    return F.length(bare) - F.length(F.regexp_replace(bare, "\t" if sep == "\t" else sep, ""))


def lineage(df: DataFrame) -> DataFrame:
    """File path and a row order that follows the file: (file, block, id)."""
    order = F.struct(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                     F.monotonically_increasing_id().alias("i"))
    return df.withColumns({"_source_file": records.listed_path(), "_ord": order})


def extract_path(path: Column) -> Column:
    """The extract a file belongs to: Spark writes an extract as a folder of
    part files, so it is the folder of a ``part-`` file, else the file."""
    parts = F.split(path, "/")
    folder = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    return F.when(F.element_at(parts, -1).startswith("part-"), folder).otherwise(path)


def _plain_scan(spark: SparkSession, paths: list[str], sep: str, names: list[str], quote: str | None) -> DataFrame:
    """Every line a record, read by Spark's CSV source (files can be split)."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    # Whether a record is malformed must not depend on the columns a query
    # happens to read: with column pruning the parser only tokenizes the
    # selected fields and never sees an extra one.
    reader = (spark.read.schema(schema).option("header", True).option("sep", sep)
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
              .option("columnPruning", False).option("enforceSchema", True))
    if quote:   # a quote inside a quoted field is doubled
        reader = reader.option("quote", quote).option("escape", quote)
    else:
        reader = reader.option("quote", "\u0000")
    return lineage(reader.csv(paths)).withColumn("_stray", F.lit(None).cast("string"))


def scan_raw(spark: SparkSession, path: str | list[str], quote: str | None = '"',
             header: tuple[str, list[str]] | None = None, staging: str | None = None) -> tuple[DataFrame, list[str]]:
    """The all-text scan with ``_long`` / ``_short`` flags and the record text
    of malformed records (``_bad``), before long ones are split off; ``_stray``
    is the line of a record whose opening quote never closes. Returns (frame,
    header). ``header`` is (delimiter, names) of all given files, else taken
    from the first.

    Files are read by Spark's CSV source, but those (and only those) in which a
    quoted field leaves a line open: their records are found by ``records``,
    through a table below ``staging``. Both ways split files."""
    paths = [path] if isinstance(path, str) else list(path)
    sep, names = header or sniff(spark, paths[0])
    mixed = records.files_by_quoting(spark, paths, sep) if quote == records.QUOTE else None
    if mixed is None:
        raw = _plain_scan(spark, paths, sep, names, quote)
    else:
        plain, spanning = mixed
        found = records.read_records(spark, spanning, sep, len(names), staging)
        raw = records.parsed(found, sep, names, CORRUPT)
        if plain:
            raw = raw.unionByName(_plain_scan(spark, plain, sep, names, quote))
    # Spark parses a record only when a data column is referenced, so the
    # test reads the corrupt text through coalesce with the first field.
    text = F.coalesce(F.col(CORRUPT), F.col(f"`{names[0]}`"))
    n_delims = _delimiters_outside_quotes(text, sep)
    corrupt = F.col(CORRUPT).isNotNull()
    long_row, short_row = corrupt & (n_delims > len(names) - 1), corrupt & (n_delims < len(names) - 1)
    return (raw.select(*[F.col(f"`{c}`") for c in names], "_source_file", "_ord",
                       F.coalesce(long_row, F.lit(False)).alias("_long"),
                       F.coalesce(short_row, F.lit(False)).alias("_short"),
                       F.when(long_row | short_row, text).alias("_bad"),
                       F.when(long_row | short_row, n_delims + 1).alias("_fields"), "_stray"), names)


def split_raw(raw: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, bad_lines) of a raw scan: long records are skipped and
    reported; header names are trimmed; all-NULL rows are dropped."""
    bad = raw.where("_long").select(
        F.col("_source_file").alias("file"), F.col(f"`{names[0]}`").alias("first_field"),
        F.format_string("Skipping line: expected %d fields, saw %d", F.lit(len(names)), F.col("_fields"))
        .alias("message"), F.col("_bad").alias("value"))
    rows = (raw.where(~F.col("_long"))
            .select(*[F.col(f"`{c}`").alias(c.strip()) for c in names], "_source_file", "_ord")
            .na.drop(how="all", subset=[c.strip() for c in names]))
    return rows, bad


def short_lines(raw: DataFrame, names: list[str]) -> DataFrame:
    """Records with fewer fields than the header: kept, the missing fields
    NULL, and reported (same columns as ``bad_lines``)."""
    return raw.where("_short").select(
        F.col("_source_file").alias("file"), F.col(f"`{names[0]}`").alias("first_field"),
        F.format_string("Short line: expected %d fields, saw %d", F.lit(len(names)), F.col("_fields")).alias("message"),
        F.col("_bad").alias("value"))


def stray_quotes(raw: DataFrame, names: list[str]) -> DataFrame:
    """Records kept with an opening quote that never closes read as text, and
    reported (same columns as ``bad_lines``)."""
    return raw.where(F.col("_stray").isNotNull()).select(
        F.col("_source_file").alias("file"), F.col(f"`{names[0]}`").alias("first_field"),
        F.lit("Unclosed quote: read as text").alias("message"), F.col("_stray").alias("value"))


def scan_tolerant(spark: SparkSession, path: str | list[str], quote: str | None = '"') -> tuple[DataFrame, DataFrame]:
    """All-text scan; returns (rows, bad_lines).

    ``rows`` keeps the raw header names (trimmed), drops all-NULL rows and
    carries ``_source_file`` / ``_ord``; ``bad_lines`` lists skipped records."""
    raw, names = scan_raw(spark, path, quote)
    return split_raw(raw, names)


def file_type_of(name: Column) -> Column:
    """S3: route a file by its name; NULL = unknown (warned and skipped)."""
    low = F.lower(name)
    out = F.when(low.contains(FILE_TYPES[0]), F.lit(FILE_TYPES[0]))
    for t in FILE_TYPES[1:]:
        out = out.when(low.contains(t), F.lit(t))
    return out


def file_period(name: Column) -> Column:
    """``x-A-B.csv`` -> ``A-B``; otherwise ``unknown``."""
    parts = F.split(name, "-")
    return F.when(F.size(parts) >= 3,
                  F.concat_ws("-", parts.getItem(1), F.split(parts.getItem(2), r"\.").getItem(0))
                  ).otherwise(F.lit("unknown"))


def list_landing(spark: SparkSession, landing: str) -> DataFrame:
    """S3: every extract in the landing folder (nested ones too) with its full
    path, route and period. The binary-file source lists files; with only
    path / length selected no content is read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .load(landing).select("path", "length"))
    name = F.element_at(F.split("extract_path", "/"), -1)
    return (files.groupBy(extract_path(F.col("path")).alias("extract_path"))
            .agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
            .select(name.alias("extract"), file_type_of(name).alias("file_type"), file_period(name).alias("period"),
                    "files", "bytes", F.col("extract_path").alias("path")))


def read_repaired(spark: SparkSession, path: str) -> DataFrame:
    """Quoted fields may span lines; inner line breaks become one space.
    Rows whatever their number of fields: a long one loses the rest, a short
    one has NULLs."""
    raw, names = scan_raw(spark, path)
    return raw.select(*[F.regexp_replace(F.col(f"`{n}`"), r"\r?\n", " ").alias(n.strip()) for n in names])
