"""Coercion rules vs small Python models of the documented behaviour, on
generated strings (one Spark job per property, all examples in one frame)."""

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from settlekit import schema as S
from settlekit.functions import numbers as NU
from settlekit.functions import text as TX

NUMBERISH = st.one_of(
    st.decimals(min_value=-10 ** 7, max_value=10 ** 7, places=3, allow_nan=False).map(str),
    st.builds(lambda d: f"₹{d:,.2f}", st.decimals(min_value=0, max_value=10 ** 7, places=2, allow_nan=False)),
    st.builds(lambda d: f"{d}%", st.decimals(min_value=-1000, max_value=1000, places=2, allow_nan=False)),
    st.sampled_from(["", "abc", " 12 ", '"7"', "1,2,3", "%", "₹", "12.5%%", "-0", "+4.5"]),
    st.none())


def _to_float(text):
    try:
        return float(text)
    except ValueError:
        return None


def model_default(v, integer):
    """Missing -> 0; strip ₹ and ','; trailing % -> /100; bad -> 0."""
    zero = 0
    if v is None or v == "":
        return zero
    s = v.replace("₹", "").replace(",", "").strip()
    if s == "":
        return zero
    x = _to_float(s[:-1]) / 100 if s.endswith("%") and _to_float(s[:-1]) is not None else (
        None if s.endswith("%") else _to_float(s))
    if x is None:
        return zero
    if integer:
        return int(x)
    return Decimal(repr(x)).quantize(Decimal("0.0001"), rounding=ROUND_HALF_UP)


def model_null(v):
    """Strip quotes and blanks; empty or not a number -> NULL."""
    if v is None:
        return None
    s = v.strip('"').strip()
    return None if s == "" else _to_float(s)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(NUMBERISH, min_size=50, max_size=200))
def test_numbers_follow_the_rules(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select("v", NU.parse_number_default(F.col("v"), S.FLOAT).alias("f"),
                     NU.parse_number_default(F.col("v"), S.INTEGER).alias("i"),
                     NU.parse_number_null(F.col("v"), S.FLOAT).alias("n")).collect()
    for r in rows:
        assert r.i == model_default(r.v, True), r
        want = model_default(r.v, False)
        assert Decimal(r.f) == Decimal(want), r
        m = model_null(r.v)
        assert (r.n is None) == (m is None), r
        if m is not None:
            assert abs(float(r.n) - m) <= 0.00005 + 1e-12 * abs(m), r


CODES = st.one_of(st.text(alphabet="0123456789ABCDEFZ ", min_size=0, max_size=17), st.none())


def model_gst(v):
    if v is None:
        return ""
    s = v.strip()
    ok = len(s) == 15 and s[:2].isdigit() and s[2:12].isalnum() and s[12:].isdigit()
    return s if ok else ""


def model_pin(v):
    if v is None:
        return ""
    s = v.strip()
    return s if len(s) == 6 and s.isdigit() else ""


def model_bool(v):
    return v is not None and v.strip().lower() in ("true", "1", "yes", "y")


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(CODES, min_size=50, max_size=200),
       st.lists(st.one_of(st.sampled_from(["TRUE", "true", " y", "No", "0", "1", "YES", "maybe", ""]),
                          st.none()), min_size=20, max_size=50))
def test_codes_and_flags_follow_the_rules(spark, codes, flags):
    df = spark.createDataFrame([(v,) for v in codes], "v string")
    for r in df.select("v", TX.gst_check(F.col("v")).alias("g"), TX.pincode_check(F.col("v")).alias("p")).collect():
        assert r.g == model_gst(r.v) and r.p == model_pin(r.v), r
    fdf = spark.createDataFrame([(v,) for v in flags], "v string")
    for r in fdf.select("v", TX.bool_default(F.col("v")).alias("b")).collect():
        assert r.b == model_bool(r.v), r
