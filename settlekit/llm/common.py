"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from settlekit.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark from wherever ``sf_dir`` points to."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and is
    read again (not recomputed) when an executor is lost. In a ``folder`` of the
    caller's it can be removed once all that reads it is written too."""
    path = f"{folder}/{name}" if folder else work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()
#: A batch of rows handed to a Python worker holds about this many bytes, so ten
#: thousand long texts never stand in a worker at once.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def shipped(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this library. Where PYTHONPATH names its
    folder they can; else its modules are added to the session as a zip file,
    which Spark hands to every executor. Batches are bounded in bytes, unless
    the session sets a bound of its own."""
    if _BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(_BATCH_KEY, BATCH_BYTES)
    sc = spark.sparkContext
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    if sc.applicationId in _SHIPPED:
        return spark
    _SHIPPED.add(sc.applicationId)
    if root in (os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p):
        return spark
    path = os.path.join(tempfile.mkdtemp(prefix="settlekit-zip-"), "settlekit.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    z.write(file, os.path.relpath(file, root))
    sc.addPyFile(path)
    return spark


def row_key(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes of a row's values, null-safe.

    Used as join key where rows have no unique id: equal rows get equal keys,
    which is what the operators want (equal rows have equal results).
    """
    return [F.xxhash64(F.lit(seed), *columns) for seed in (11, 29)]


def fresh_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that the operator is about to add (its own win)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def plain_columns(df: DataFrame) -> list[Column]:
    """The columns that are not nested, in order (they make up a row's key)."""
    return [F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "variant"))]
