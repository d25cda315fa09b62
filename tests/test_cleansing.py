"""Coercion rules on the hand-written cleansing inputs."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from settlekit import schema as S
from settlekit.functions import dates as DT
from settlekit.functions import numbers as NU
from settlekit.functions import text as TX

RUN = dt.datetime(2025, 4, 15, 10, 0, 0)


def _col(spark, values, name="v"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_dates_default_policy(spark):
    cases = {
        "2025-03-31": dt.datetime(2025, 3, 31),
        "31-03-2025": dt.datetime(2025, 3, 31),
        "2025/03/31": dt.datetime(2025, 3, 31),
        "31/03/2025": dt.datetime(2025, 3, 31),
        "2025-03-31 18:49:41": dt.datetime(2025, 3, 31, 18, 49, 41),
        "31-03-2025 08:01": dt.datetime(2025, 3, 31, 8, 1),
        "3/1/25 5:07": dt.datetime(2025, 3, 1, 5, 7),
        "03/01/2025 05:07": dt.datetime(2025, 1, 3, 5, 7),      # day-first layout is tried first
        "12/25/96 00:00": dt.datetime(1996, 12, 25),           # two-digit year pivot
        "20250331": dt.datetime(2025, 3, 31),
        "31032025": dt.datetime(2025, 3, 31),
        "39:49.0": dt.datetime(2025, 4, 15, 0, 39, 49),
        "40:00.0": dt.datetime(2025, 4, 15, 0, 40, 0),
        "2025-03-31 18:49:41.123456": dt.datetime(2025, 3, 31, 18, 49, 41, 123456),
        "junk": RUN,
        "": RUN,
    }
    df = _col(spark, list(cases) + [None])
    run = DT.ts_lit(RUN)
    rows = df.select("v", DT.parse_date_default(F.col("v"), "created_on", run).alias("c"),
                     DT.parse_date_default(F.col("v"), "packed_on", run).alias("p")).collect()
    got = {r.v: (r.c, r.p) for r in rows}
    for raw, want in cases.items():
        assert got[raw][0] == want, raw
    assert got[None] == (RUN, None)
    assert got[""][1] is None


def test_dates_null_policy(spark):
    df = _col(spark, ['"03/01/2025 05:07"', "3/1/25 5:07", "2025-03-31 18:49:41", "2025-03-31", "junk", None])
    got = [r.c for r in df.select(DT.parse_date_null(F.col("v"), DT.ts_lit(RUN)).alias("c")).collect()]
    assert got == [dt.datetime(2025, 3, 1, 5, 7), dt.datetime(2025, 3, 1, 5, 7),
                   dt.datetime(2025, 3, 31, 18, 49, 41), dt.datetime(2025, 3, 31), None, None]


def test_numbers(spark):
    vals = ["₹1,234.50", "12.5%", "12.9", "abc", "", None, '"7"', "-3.7"]
    df = _col(spark, vals)
    rows = df.select(NU.parse_number_default(F.col("v"), S.FLOAT).alias("f"),
                     NU.parse_number_default(F.col("v"), S.INTEGER).alias("i"),
                     NU.parse_number_null(F.col("v"), S.FLOAT).alias("nf"),
                     NU.parse_number_null(F.col("v"), S.INTEGER).alias("ni"),
                     NU.parse_number_default(F.col("v"), S.FLOAT, 0, 100).alias("clamped")).collect()
    assert [r.f for r in rows] == [Decimal("1234.5"), Decimal("0.125"), Decimal("12.9"), 0, 0, 0, 0, Decimal("-3.7")]
    assert [r.i for r in rows] == [1234, 0, 12, 0, 0, 0, 0, -3]
    assert [r.nf for r in rows] == [None, None, Decimal("12.9"), None, None, None, Decimal(7), Decimal("-3.7")]
    assert [r.ni for r in rows] == [None, None, 12, None, None, None, 7, -3]
    assert [r.clamped for r in rows][0] == 100 and [r.clamped for r in rows][-1] == 0


def test_booleans(spark):
    df = _col(spark, ["TRUE", "y", "No", "2", None, "True", "1"])
    rows = df.select(TX.bool_default(F.col("v")).alias("d"), TX.bool_utils(F.col("v")).alias("u"),
                     TX.bool_repair(F.col("v")).alias("r")).collect()
    assert [r.d for r in rows] == [True, True, False, False, False, True, True]
    assert [r.u for r in rows] == [True, True, False, False, False, True, True]
    assert [r.r for r in rows] == [True, False, False, False, False, True, True]


def test_codes_and_strings(spark):
    df = _col(spark, ["27ABCDE1234F123", "27ABCDE1234F12", "27ABCDE1234F1Z5", " 560001 ", "56000", "ABCDEF", None])
    rows = df.select(TX.gst_check(F.col("v")).alias("g"), TX.pincode_check(F.col("v")).alias("p"),
                     TX.string_clean(F.col("v"), 5, "27").alias("s")).collect()
    assert [r.g for r in rows] == ["27ABCDE1234F123", "", "", "", "", "", ""]
    assert [r.p for r in rows] == ["", "", "", "560001", "", "", ""]
    assert [r.s for r in rows] == ["27ABC", "27ABC", "27ABC", "", "", "", ""]


def test_money_and_percent_text(spark):
    df = spark.createDataFrame([(Decimal("1234.5"), 12.345), (Decimal("-1.005"), 8.445)],
                               "m decimal(18,4), p double")
    rows = df.select(TX.currency_text(F.col("m")).alias("m"), TX.percent_text(F.col("p")).alias("p")).collect()
    assert [r.m for r in rows] == ["₹1,234.50", "₹-1.01"]
    assert [r.p for r in rows] == ["12.35%", "8.45%"]


def test_clean_reads_missing_spellings_as_null_and_keeps_strings(spark):
    from settlekit.operators.cleanse import clean
    raw = spark.createDataFrame(
        [("1", " Brand A ", "NULL", "n/a"), ("2", "nan", "100", "2025-03-31"), ("3", "NA", "", "None")],
        "`order release id` string, brand string, `final amount` string, `created on` string")
    rows = {r.order_release_id: r for r in clean(raw, "orders", "default", RUN).df.collect()}
    assert rows["1"].brand == " Brand A "                  # kept as read
    assert rows["2"].brand is None and rows["3"].brand is None
    assert rows["1"].final_amount == 0 and rows["2"].final_amount == 100
    assert rows["1"].created_on == RUN and rows["3"].created_on == RUN   # missing date -> run time
    assert rows["2"].created_on == dt.datetime(2025, 3, 31)
