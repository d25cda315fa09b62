"""Sinks (K1-K7). Every write goes to a new folder; nothing overwrites a
path that the same job is reading (Spark reads lazily, so overwriting an
input in place could destroy it mid-job). Masters and snapshots are
versioned folders plus a small pointer file naming the current version.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "_CURRENT"


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_text_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file via a temporary name and a rename, so a reader
    never sees a half-written pointer (at worst none, see ``current_master``)."""
    fs, p = _hadoop_fs(spark, path)
    jvm = spark.sparkContext._jvm
    tmp = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    fs.rename(tmp, p)


def _read_text_file(spark: SparkSession, path: str) -> str | None:
    fs, p = _hadoop_fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    reader = spark.sparkContext._jvm.java.io.BufferedReader(
        spark.sparkContext._jvm.java.io.InputStreamReader(stream, "UTF-8"))
    line = reader.readLine()
    reader.close()
    return line


BUCKETS_MARKER = "_BUCKETS"


def write_version(df: DataFrame, version: str, buckets: int | None = None,
                  bucket_key: str = "order_release_id", overwrite: bool = False) -> None:
    """Write one master version folder, optionally bucketed (and sorted) by
    ``bucket_key``: joins and aggregations on the order key then read it
    without a shuffle. The bucket spec is kept in a ``_BUCKETS`` file of the
    folder (Spark ignores ``_`` files) and re-registered by ``read_version``."""
    spark = df.sparkSession
    mode = "overwrite" if overwrite else "errorifexists"
    if buckets:
        tmp = f"settlekit_write_{uuid.uuid4().hex}"
        # one file per bucket (no exchange when already partitioned this way)
        (df.repartition(buckets, bucket_key).write.mode(mode).bucketBy(buckets, bucket_key)
           .sortBy(bucket_key).option("path", version).saveAsTable(tmp))
        spark.sql(f"DROP TABLE IF EXISTS {tmp}")          # external: the files stay
        _write_text_file(spark, f"{version}/{BUCKETS_MARKER}", f"{buckets} {bucket_key}")
    else:
        df.write.mode(mode).parquet(version)


COMMITS = "_commits"


def write_master(df: DataFrame, root: str, entity: str, buckets: int | None = None,
                 bucket_key: str = "order_release_id", commit: str | None = None) -> str:
    """K1: write a new version of a master table and point to it. ``commit``
    names the micro-batch it comes from (see ``committed``)."""
    # nanosecond clock: versions sort by name in write order
    base = f"{root.rstrip('/')}/{entity}"
    version = f"{base}/v={time.time_ns():020d}"
    write_version(df, version, buckets, bucket_key)
    point_to(df.sparkSession, base, version, commit)
    return version


def point_to(spark: SparkSession, base: str, version: str, commit: str | None = None) -> None:
    """Make a written version the current one, under the name of its micro-batch."""
    if commit:
        _write_text_file(spark, f"{base}/{COMMITS}/{commit}", version)
    _write_text_file(spark, f"{base}/{POINTER}", version)


def committed(spark: SparkSession, root: str, entity: str, commit: str) -> bool:
    """Is a micro-batch (named by checkpoint and batch number) in the master?
    If its writer died just before moving the pointer, the pointer moves now."""
    base = f"{root.rstrip('/')}/{entity}"
    version = _read_text_file(spark, f"{base}/{COMMITS}/{commit}")
    if not version:
        return False
    line = _read_text_file(spark, f"{base}/{POINTER}")
    if not line or line.strip().rsplit("/", 1)[-1] < version.strip().rsplit("/", 1)[-1]:
        _write_text_file(spark, f"{base}/{POINTER}", version.strip())
    return True


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staging folder of this run."""
    fs, p = _hadoop_fs(spark, path)
    fs.delete(p, True)


def bucket_spec(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """(buckets, key) of a bucketed master version, else None."""
    marker = _read_text_file(spark, f"{path}/{BUCKETS_MARKER}")
    if not marker:
        return None
    n, key = marker.split()
    return int(n), key


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """A written master version; a bucketed one is registered with its
    bucket spec so the planner can use it, one of a manifest names its folders."""
    from settlekit import masters
    listed = masters.read_version(spark, path)
    if listed is not None:
        return listed
    marker = _read_text_file(spark, f"{path}/{BUCKETS_MARKER}")
    if not marker:
        return spark.read.parquet(path)
    buckets, key = marker.split()
    name = "settlekit_" + hashlib.sha1(path.encode("utf-8")).hexdigest()[:20]
    if not spark.catalog.tableExists(name):
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet CLUSTERED BY (`{key}`) "
                  f"SORTED BY (`{key}`) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def current_master(spark: SparkSession, root: str, entity: str) -> str | None:
    """Path of the current version of a master table (None if none yet).

    Without a readable pointer (a writer died between delete and rename), the
    newest version folder that was written completely (``_SUCCESS``) is used."""
    base = f"{root.rstrip('/')}/{entity}"
    line = _read_text_file(spark, f"{base}/{POINTER}")
    if line and line.strip():
        return line.strip()
    return _latest_complete_version(spark, base)


def _latest_complete_version(spark: SparkSession, base: str) -> str | None:
    fs, p = _hadoop_fs(spark, base)
    if not fs.exists(p):
        return None
    jvm = spark.sparkContext._jvm
    done = [st.getPath().toString() for st in fs.listStatus(p)
            if st.isDirectory() and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))]
    return sorted(done)[-1] if done else None


def write_analysis(a: DataFrame, path: str) -> None:
    """K2: analysis table partitioned by month (prunes month filters).

    The ``rebalance`` hint lets AQE shuffle rows by month into partitions of
    the advisory size, splitting a hot month over several tasks, so each
    task writes few month folders (not one file per task and month)."""
    a.hint("rebalance", "settlement_month").write.mode("errorifexists").partitionBy("settlement_month").parquet(path)


def write_anomalies(anoms: DataFrame, path: str) -> bool:
    """K3: written only when there is at least one anomaly."""
    if anoms.isEmpty():
        return False
    anoms.write.mode("overwrite").parquet(path)
    return True


def write_report(lines: DataFrame, path: str) -> None:
    """K4: report lines in order into one text file (a report is bounded by
    the number of months, so one task is right here)."""
    (lines.orderBy("block", "item").select("text").coalesce(1)
     .write.mode("overwrite").text(path))


def write_issues_json(issues: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K5: validation issues as JSON, one folder per file type."""
    issues.write.mode(mode).partitionBy("file_type").json(path)


def snapshot(tables: dict[str, DataFrame], root: str, ts: _dt.datetime | None = None) -> str:
    """K6: copy of all masters under one snapshot timestamp."""
    stamp = f"{(ts or _dt.datetime.now()):%Y%m%d_%H%M%S}"
    base = f"{root.rstrip('/')}/snapshot_ts={stamp}"
    for name, df in tables.items():   # a rerun of the same run replaces its snapshot
        df.write.mode("overwrite").parquet(f"{base}/{name}")
    return base


def snapshot_versions(spark: SparkSession, root: str, entities, snapshots: str, ts: _dt.datetime) -> str:
    """K6 for versioned masters: which version each master has now. Versions
    are never rewritten, so the list is the snapshot and costs no copy."""
    base = f"{snapshots.rstrip('/')}/snapshot_ts={ts:%Y%m%d_%H%M%S}"
    rows = [(e, v) for e in entities if (v := current_master(spark, root, e))]
    (spark.createDataFrame(rows, "entity string, version string").coalesce(1).write.mode("overwrite").json(f"{base}/versions"))
    return base


def snapshot_list(spark: SparkSession, snapshots: str) -> DataFrame:
    """(entity, version) of every snapshot taken so far."""
    fs, p = _hadoop_fs(spark, snapshots)
    schema = "entity string, version string"
    taken = [st.getPath().toString() + "/versions" for st in fs.listStatus(p) if st.isDirectory()] if fs.exists(p) else []
    return spark.read.schema(schema).json(taken) if taken else spark.createDataFrame([], schema)


def read_snapshot(spark: SparkSession, base: str, entity: str) -> DataFrame | None:
    """A master as it was when the snapshot was taken; None if there was none."""
    rows = spark.read.schema("entity string, version string").json(f"{base}/versions").where(F.col("entity") == entity).collect()
    return read_version(spark, rows[0]["version"]) if rows else None


def write_repaired_csv(df: DataFrame, path: str) -> None:
    """K7: minimal quoting, backslash escape, whole-second timestamps."""
    (df.write.mode("overwrite").option("header", True).option("escape", "\\")
     .option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("text"))
