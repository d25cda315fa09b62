"""Boolean, string and code checks; currency / percent text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: accepted boolean spellings and code layouts ------------------
TRUE_DEFAULT = ["true", "1", "yes", "y"]          # compared lower-cased
TRUE_UTILS = ["TRUE", "1", "YES", "Y"]            # compared upper-cased
FALSE_SPELLINGS = ["false", "0", "no", "n"]       # a no that is no mistake
TRUE_REPAIR = ["TRUE", "True", "1"]               # exact
GST_PATTERN = "^[0-9]{2}[A-Za-z0-9]{10}[0-9]{3}$"
PIN_PATTERN = "^[0-9]{6}$"
# --- end fixed values ---------------------------------------------------------------


def bool_default(raw: Column) -> Column:
    """P10 (validation): true/1/yes/y -> True, anything else -> False."""
    return F.coalesce(F.lower(F.trim(raw.cast("string"))).isin(TRUE_DEFAULT), F.lit(False))


def bool_utils(raw: Column) -> Column:
    """P10 (reader): TRUE/1/YES/Y after upper-casing."""
    return F.coalesce(F.upper(F.trim(raw.cast("string"))).isin(TRUE_UTILS), F.lit(False))


def bool_repair(raw: Column) -> Column:
    """P10 (repair): exact TRUE/True/1; everything else False."""
    return F.coalesce(raw.cast("string").isin(TRUE_REPAIR), F.lit(False))


def unread_bool(raw: Column) -> Column:
    """Is there a text that is neither a usual yes nor a usual no?"""
    v = F.lower(F.trim(raw.cast("string")))
    return F.coalesce((v != "") & ~v.isin([*TRUE_DEFAULT, *FALSE_SPELLINGS]), F.lit(False))


def string_clean(raw: Column, max_length: int | None = None, pattern: str | None = None) -> Column:
    """Trim; truncate; a value not matching ``pattern`` at its start -> ''."""
    v = F.trim(raw.cast("string"))
    if max_length is not None:
        v = F.substring(v, 1, max_length)
    out = v
    if pattern is not None:
        out = F.when(v.rlike("^(?:" + pattern + ")"), v).otherwise(F.lit(""))
    return F.when(raw.isNull() | (raw.cast("string") == ""), F.lit("")).otherwise(out)


def gst_check(raw: Column) -> Column:
    """15 characters: 2 digits, 10 letters/digits, 3 digits; else ''."""
    v = F.trim(raw.cast("string"))
    return F.when(F.coalesce(v.rlike(GST_PATTERN), F.lit(False)), v).otherwise(F.lit(""))


def pincode_check(raw: Column) -> Column:
    """Exactly six digits; else ''."""
    v = F.trim(raw.cast("string"))
    return F.when(F.coalesce(v.rlike(PIN_PATTERN), F.lit(False)), v).otherwise(F.lit(""))


def string_repair(raw: Column) -> Column:
    """P7 strings: missing -> ''."""
    return F.coalesce(raw.cast("string"), F.lit(""))


def currency_text(x: Column) -> Column:
    """``₹1,234.50`` (rounded half-up to cents, then grouped)."""
    return F.concat(F.lit("₹"), F.format_number(F.round(x, 2), 2))


def percent_text(x: Column) -> Column:
    """``12.34%`` (no grouping; half-up at cents of the value taken to
    ten decimals, so the text does not depend on binary rounding)."""
    return F.concat(F.format_string("%.2f", F.round(x.cast("decimal(38,10)"), 2).cast("double")), F.lit("%"))
