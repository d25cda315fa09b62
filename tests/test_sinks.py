"""Sinks: formats and layouts (K3, K5, K6, K7)."""

import datetime as dt
import os
import tempfile
from decimal import Decimal

from settlekit import sinks
from settlekit.operators.cleanse import ISSUE_SCHEMA


def test_issues_json_by_file_type_and_snapshot(spark):
    root = tempfile.mkdtemp(prefix="sinks-")
    issues = spark.createDataFrame([("orders", "error", 0, "brand", "m1", None),
                                    ("returns", "warning", 0, "x", "m2", None)], ISSUE_SCHEMA)
    sinks.write_issues_json(issues, f"{root}/issues")
    assert sorted(d for d in os.listdir(f"{root}/issues") if d.startswith("file_type=")) == \
        ["file_type=orders", "file_type=returns"]
    assert spark.read.json(f"{root}/issues").count() == 2
    t = spark.createDataFrame([("a",)], "k string")
    base = sinks.snapshot({"orders": t, "returns": t}, f"{root}/snap", dt.datetime(2025, 3, 31, 18, 40, 57))
    assert base.endswith("snapshot_ts=20250331_184057")
    assert spark.read.parquet(f"{base}/orders").count() == 1


def test_repaired_csv_has_whole_second_timestamps(spark):
    root = tempfile.mkdtemp(prefix="k7-")
    df = spark.createDataFrame([("a", dt.datetime(2025, 3, 31, 18, 49, 41, 123456), Decimal("599.004"))],
                               "k string, upload_timestamp timestamp, amount decimal(18,4)")
    sinks.write_repaired_csv(df, f"{root}/out")
    text = "".join(open(os.path.join(f"{root}/out", f)).read() for f in os.listdir(f"{root}/out")
                   if f.startswith("part-"))
    assert "2025-03-31 18:49:41," in text and "599.0040" in text


def test_anomalies_written_only_when_present(spark):
    root = tempfile.mkdtemp(prefix="k3-")
    empty = spark.createDataFrame([], "type string, order_release_id string")
    assert not sinks.write_anomalies(empty, f"{root}/none") and not os.path.exists(f"{root}/none")
    one = spark.createDataFrame([("Negative Profit", "1")], "type string, order_release_id string")
    assert sinks.write_anomalies(one, f"{root}/one") and spark.read.parquet(f"{root}/one").count() == 1


def test_shuffle_partitions_sized_from_input_bytes(spark):
    from settlekit.session import MOST_PARTITIONS, input_bytes, sized_shuffle_partitions
    root = tempfile.mkdtemp(prefix="size-")
    spark.range(1000).write.parquet(f"{root}/t")
    n = input_bytes(spark, f"{root}/t", f"{root}/missing")
    assert n > 0
    old = spark.conf.get("spark.sql.shuffle.partitions")
    with sized_shuffle_partitions(spark, n) as small:
        assert small == int(old)                                     # small input: unchanged
    with sized_shuffle_partitions(spark, 2 ** 40) as large:
        assert large == 5243                                         # 1 TiB / 200 MiB
        assert spark.conf.get("spark.sql.shuffle.partitions") == "5243"
    with sized_shuffle_partitions(spark, 100 * 2 ** 40) as most:
        assert most == MOST_PARTITIONS                               # beyond it partitions grow
    assert spark.conf.get("spark.sql.shuffle.partitions") == old     # restored
