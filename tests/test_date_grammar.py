"""Free-form dates: tokenised, classified, resolved."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from settlekit.functions import dates as D

AT = dt.datetime(2025, 3, 4, 15, 6, 7)
MIDNIGHT = AT.replace(hour=0, minute=0, second=0)

CASES = {
    "Tue, 04 Mar 2025 15:06:07 GMT": AT, "Tue, 04 Mar 2025 15:06:07 +0530": AT - dt.timedelta(hours=5, minutes=30),
    "Tuesday, March 4, 2025 3:06:07 PM": AT, "March 4th, 2025 3:06 p.m.": AT.replace(second=0), "4 March 2025, 3 pm": AT.replace(minute=0, second=0),
    "mar 4 2025 15:06:07.250": AT.replace(microsecond=250000), "2025 Mar 4": MIDNIGHT, "4-mar-25": MIDNIGHT, "04/03/2025 12:06 am": dt.datetime(2025, 4, 3, 0, 6),
    "13/03/2025 12:06 PM": dt.datetime(2025, 3, 13, 12, 6), "2025.3.4 15:06:07Z": AT, "2025/3/4T15:06:07-08:00": AT + dt.timedelta(hours=8),
    "March 2025": dt.datetime(2025, 3, 1), "Sept 4, 1999": dt.datetime(1999, 9, 4), "3/4/69": dt.datetime(1969, 3, 4), "20250304 15:06:07": AT,
    "wed 5th mar 2025": dt.datetime(2025, 3, 5), "  4   Mar   2025 ": MIDNIGHT,
    # no dates
    "not a date": None, "janitor 4 2025": None, "31/02/2025": None, "4 mar mar 2025": None, "1,234": None, "12.5": None, "13:70": None, "Mar 4 2025 13 pm": None,
    "Mar 4 2025 24:00": None, "4 March 2025 x": None, "5551234567": None, "1/2/3/4": None, "Mar 4 2025 10:00:75": None, "tuesday": None, "10:00": None, "4 mär 2025": None,
}


def test_each_text(spark):
    got = spark.createDataFrame([(t,) for t in CASES], "t string").select("t", D.fallback(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in got} == CASES


@pytest.mark.parametrize("layout", ["EEE, dd MMM yyyy HH:mm:ss", "EEEE, MMMM d, yyyy h:mm:ss a", "d MMMM yyyy h:mm:ss a", "yyyy MMM d HH:mm:ss", "d-MMM-yyyy H:m:s", "M/d/yyyy h:mm:ss a"])
def test_layouts_over_many_instants(spark, layout):
    at = (F.lit(1_000_000_000) + F.col("id") * 7_654_321).cast("timestamp")
    df = spark.range(120).select(at.alias("at"), D.fallback(F.date_format(at, layout)).alias("x"))
    # only numbers: the first may be a day when it is over 12, never here
    assert df.where(~F.col("at").eqNullSafe(F.col("x"))).collect() == []
