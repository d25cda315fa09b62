"""Intake: nothing that lands is lost or misread."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from settlekit import schema as S
from settlekit import sinks
from settlekit.functions import dates as D
from settlekit.functions import numbers as N
from settlekit.operators import merge as MG
from settlekit.operators.skew import join_unique
from settlekit.plans import batch as BT
from settlekit.sources import csv as CSV
from settlekit.streaming import incremental as INC

RUN_TS = dt.datetime(2025, 4, 1)
HEADER = "order_release_id,order_line_id,return_type,return_date,total_actual_settlement,upload_timestamp"


def land(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)


def test_quoted_line_breaks_and_doubled_quotes(spark):
    root = tempfile.mkdtemp(prefix="land-")
    land(root, "orders.csv", 'id,brand,amount\n1,"line one\nline two",10\n2,"say ""hi"", ok",20\n3,x\n4,y,5,6\n')
    raw, names = CSV.scan_raw(spark, os.path.join(root, "orders.csv"))
    rows, bad = CSV.split_raw(raw, names)
    assert [tuple(r)[:3] for r in rows.orderBy("id").collect()] == [("1", "line one\nline two", "10"), ("2", 'say "hi", ok', "20"), ("3", "x", None)]
    assert [r.message for r in bad.collect()] == ["Skipping line: expected 3 fields, saw 4"]
    assert [r.message for r in CSV.short_lines(raw, names).collect()] == ["Short line: expected 3 fields, saw 2"]


@pytest.mark.parametrize("streamed", [False, True])
def test_mixed_landing_folder(spark, streamed):
    """Plain and nested files of one name, other column orders, an empty file, an unknown type."""
    root, wh = tempfile.mkdtemp(prefix="land-"), tempfile.mkdtemp(prefix="wh-")
    land(root, "returns-01-2025.csv", HEADER + "\n1,1,C,2025-01-01,5,2025-01-02 00:00:00\n")
    land(root, "b/returns-01-2025.csv", "upload_timestamp,order_line_id,order_release_id,return_type,return_date,total_actual_settlement\n"
         "2025-01-03 00:00:00,1,2,D,2025-01-01,7\n2025-01-03 00:00:00,1,3\n")
    land(root, "returns-empty.csv", "\n")
    land(root, "notes.csv", "a,b\n1,2\n")
    if streamed:
        out = INC.incremental_merge(spark, root, "returns", wh, f"{wh}/ckpt", RUN_TS, files_per_batch=1)
        issues = INC.batch_issues(spark, wh)
        runs = [d for d in os.listdir(f"{wh}/streamed/issues") if d.startswith("batch=")]
        assert len(runs) >= 3   # the limit of files holds per micro-batch
    else:
        done = BT.ingest(spark, root, wh, RUN_TS)
        out, issues = BT._master(spark, wh, "returns"), done["issues"]
    got = {(r.order_release_id, r.return_type, float(r.total_actual_settlement)) for r in out.collect()}
    assert got == {("1", "C", 5.0), ("2", "D", 7.0), ("3", "", 0.0)} or got == {("1", "C", 5.0), ("2", "D", 7.0), ("3", None, 0.0)}
    messages = {r.message for r in issues.collect()}
    assert "Error processing file returns-empty.csv: the file is empty" in messages
    assert "Short line: expected 6 fields, saw 3" in messages


def test_snapshot_names_the_state_before_the_run(spark):
    root, wh = tempfile.mkdtemp(prefix="land-"), tempfile.mkdtemp(prefix="wh-")
    header = "order_release_id,order_line_id,order_status,is_ship_rel,created_on,upload_timestamp\n"
    land(root, "orders-01-2025.csv", header + "1,1,D,1,2025-01-01,2025-01-02 00:00:00\n")
    first = BT.run_batch(spark, root, wh, dt.datetime(2025, 4, 1))
    assert sinks.read_snapshot(spark, first.paths["snapshot"], "orders") is None
    land(root, "orders-02-2025.csv", header + "2,1,D,1,2025-02-01,2025-02-02 00:00:00\n")
    second = BT.run_batch(spark, root, wh, dt.datetime(2025, 4, 2))
    assert sinks.read_snapshot(spark, second.paths["snapshot"], "orders").count() == 1
    assert BT._master(spark, wh, "orders").count() == 2
    assert not os.listdir(f"{wh}/staging")   # cleaned up after the commit


def test_bucketed_merge_with_missing_key_parts_and_new_columns(spark):
    old = spark.createDataFrame([("a", None, 1, "2025-01-01"), ("b", "1", 1, "2025-01-01"), (None, None, 1, "2025-01-01")], "order_release_id string, order_line_id string, v int, u string")
    new = spark.createDataFrame([("a", None, 2, "2025-01-02", "x"), ("c", "1", 2, "2025-01-02", "y"), ("b", "1", 0, "2024-01-01", "z"), (None, None, 3, "2025-01-03", "w")],
                                "order_release_id string, order_line_id string, v int, u string, extra string")
    old, new = (df.withColumn("upload_timestamp", F.col("u").cast("timestamp")).drop("u") for df in (old, new))
    path = f"{tempfile.mkdtemp(prefix='bucketed-')}/v"
    sinks.write_version(old, path, 4)
    plain = MG.merge_latest(old, new, order_col=None)
    bucketed = MG.merge_latest_bucketed(sinks.read_version(spark, path), new, 4, order_col=None)
    assert set(bucketed.columns) == set(plain.columns)
    key = lambda r: tuple(str(r[c]) for c in sorted(plain.columns))
    assert sorted(map(key, bucketed.collect())) == sorted(map(key, plain.collect()))
    assert bucketed.where("order_release_id = 'a'").count() == 1


@pytest.mark.parametrize("text,p5,p6", [
    ("3/31/2025", "2025-03-31", "2025-03-31"), ("03/31/25", "2025-03-31", "2025-03-31"), ("31-Mar-2025", "2025-03-31", "2025-03-31"),
    ("Mar 31, 2025", "2025-03-31", "2025-03-31"), ("31-03-25", "2025-03-31", "2025-03-31"), ("31-03-2025", "2025-03-31", "2025-03-31"),
    ("2025/03/31", "2025-03-31", "2025-03-31"), ("31/03/2025", "2025-03-31", "2025-03-31"), ("4 March 1998", "1998-03-04", "1998-03-04"),
    ("05/03/2025", "2025-03-05", "2025-05-03"), ("13/13/2025", "run", None), ("Foo 3, 2025", "run", None), ("2/30/2025", "run", None)])
def test_date_fallback(spark, text, p5, p6):
    run = D.ts_lit(RUN_TS)
    r = spark.createDataFrame([(text,)], "v string").select(D.parse_date_default(F.col("v"), "created_on", run).alias("p5"),
                                                           D.parse_date_null(F.col("v"), run).alias("p6"), D.parse_date_coerce(F.col("v")).alias("p7")).first()
    assert str(r.p5.date()) == (str(RUN_TS.date()) if p5 == "run" else p5)
    assert (r.p6 and str(r.p6.date())) == p6 and (r.p7 and str(r.p7.date())) == p6


@pytest.mark.parametrize("text,value", [("12d", None), ("5F", None), ("1e3", "1000"), ("123456789012345678.25", "123456789012345678.25"),
                                        ("-.5", "-0.5"), ("1_000", "1000"), ("1__0", None), ("NaN", None), ("+7.", "7"), ("9" * 40, None)])
def test_number_texts(spark, text, value):
    from decimal import Decimal
    v = F.col("v")
    r = spark.createDataFrame([(text,)], "v string").select(N.parse_number_default(v, S.FLOAT).alias("p8"), N.parse_number_null(v, S.FLOAT).alias("p9")).first()
    want = None if value is None else Decimal(value)
    assert r.p9 == want and r.p8 == (want or 0)


def test_identical_rows_of_a_hot_key_spread_over_salts(spark):
    big = spark.range(4000).select(F.lit("hot").alias("k"), F.lit(1).alias("same"))
    small = spark.createDataFrame([("hot", 5)], "k string, x int")
    out = join_unique(big, small, "k", min_rows=100)
    assert out.count() == 4000 and out.select("x").distinct().count() == 1
