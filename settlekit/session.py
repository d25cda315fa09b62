"""Spark session defaults for the reconciliation jobs.

On a cluster the session is created by the platform; ``tune`` only sets
options that are still unset, so cluster-level settings always win.
"""

from __future__ import annotations

import contextlib
import os
import tempfile

from pyspark.sql import SparkSession

# Options every job relies on. AQE re-plans joins at runtime (broadcast
# only when the measured side is below the threshold, skew-join splitting,
# partition coalescing), UTC keeps timestamp text stable across machines.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Files are split into ~128 MB partitions by default; keep it explicit
    # so executor memory sizing can rely on it.
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "settlekit") -> SparkSession:
    """Return the active session, creating a local one for tests/bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("SETTLEKIT_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session. Only when it is unset
    (local tests) a fresh scratch folder is created and registered.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if conf_dir:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="settlekit-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


# Target bytes per shuffle partition when sizing from the input.
TARGET_PARTITION_BYTES = 200 * 1024 * 1024


#: Bytes of text for one of a gzip file, about.
GZIP_TEXT = 6


def landed_bytes(spark: SparkSession, *paths: str) -> int:
    """``input_bytes`` of landed extracts as text: a gzip file counts for what it holds, about."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        files = fs.listFiles(path, True) if fs.exists(path) else None
        while files is not None and files.hasNext():
            f = files.next()
            total += f.getLen() * (GZIP_TEXT if f.getPath().getName().endswith(".gz") else 1)
    return total


def input_bytes(spark: SparkSession, *paths: str) -> int:
    """Total size of files under the given folders (file-system metadata, no scan)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            total += fs.getContentSummary(path).getLength()
    return total


# Landed text for one task, and staged Parquet for one split: a few bytes a row
# there, so a split of the default size would be sorted as gigabytes of rows.
LANDED_PARTITION_BYTES = 64 * 1024 * 1024
STAGED_SPLIT_BYTES = 16 * 1024 * 1024


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the jobs started within the block, restored after."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def without_old_shuffles(spark: SparkSession):
    """Within the block a query's shuffle files are deleted as soon as it ends.
    Else they stay until the driver's garbage collector finds them unused, and
    a run of many written steps holds the shuffles of all of them on disk."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


# The driver tracks every partition of every exchange: beyond this many, they
# grow instead.
MOST_PARTITIONS = 20_000


@contextlib.contextmanager
def sized_shuffle_partitions(spark: SparkSession, nbytes: int, target: int = TARGET_PARTITION_BYTES):
    """Within the block ``spark.sql.shuffle.partitions`` is about ``nbytes /
    target`` (never lower than before, ``MOST_PARTITIONS`` at most), so a
    partition fits an executor's memory; AQE coalesces small ones. The setting
    is restored afterwards."""
    before = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(before, min(MOST_PARTITIONS, -(-nbytes // target)))
    with settings(spark, {"spark.sql.shuffle.partitions": str(wanted)}):
        yield wanted


@contextlib.contextmanager
def sized_ingest(spark: SparkSession, nbytes: int):
    """Within the block shuffles and scans of staged tables are cut by the size
    of the landed text (``nbytes``), so that a task's rows do not grow with it;
    shuffle files go when the query that wrote them ends."""
    split = min(STAGED_SPLIT_BYTES, int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes"))))
    with sized_shuffle_partitions(spark, nbytes, LANDED_PARTITION_BYTES) as n, settings(spark, {"spark.sql.files.maxPartitionBytes": str(split)}), without_old_shuffles(spark):
        yield n
