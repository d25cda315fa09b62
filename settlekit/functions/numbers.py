"""Numeric coercion as native expressions.

A text is a number if Python's ``float`` would read it (no suffix letters, as
a plain cast would accept); it is then parsed as an exact decimal, so no digit
of a long amount is lost. Money is stored as ``schema.MONEY``, integers as
``long`` (truncated toward zero, like ``int()``). ``try_cast`` keeps ANSI mode
from failing a whole job on one bad cell.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from settlekit.schema import INTEGER, MONEY

# --- fixed values: characters removed before parsing a money text -------------
MONEY_NOISE = "₹,"
# --- end fixed values ---------------------------------------------------------------


NUMBER = r"^[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
EXACT = "decimal(38,10)"


def number(v: Column) -> Column:
    """Exact value of a number text, NULL for any other text. Values beyond
    28 digits before the point are not amounts: NULL."""
    return F.when(v.rlike(NUMBER), F.replace(v, F.lit("_"), F.lit("")).try_cast(EXACT))


def to_kind(x: Column, kind: str) -> Column:
    """Store a parsed number in the declared type (integer truncates)."""
    if kind == INTEGER:
        return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).try_cast("long")
    return x.try_cast(MONEY)


def _amount(s: Column) -> tuple[Column, Column]:
    """(text without currency signs and grouping, its value); % divides by 100."""
    v = F.trim(F.translate(s, MONEY_NOISE, ""))
    pct = v.endswith("%")
    return v, F.when(pct, (number(F.trim(v.substr(F.lit(1), F.length(v) - 1))) / 100).try_cast(EXACT)).otherwise(number(v))


def unread_number(raw: Column, kind: str, policy: str) -> Column:
    """Is there a text that the policy's parse can't read as this kind of number?"""
    s = raw.cast("string")
    if policy == "default":
        v, x = _amount(s)
        return F.coalesce((v != "") & to_kind(x, kind).isNull(), F.lit(False))
    parsed = parse_number_null(raw, kind) if policy == "null" else parse_number_coerce(raw, kind)
    return F.coalesce((F.trim(F.regexp_replace(s, r'^"+|"+$', "")) != "") & parsed.isNull(), F.lit(False))


def parse_number_default(raw: Column, kind: str, min_value: float | None = None,
                         max_value: float | None = None) -> Column:
    """missing/'' -> 0; strip ₹ and ','; trailing % -> /100; clamp;
    failure -> 0."""
    s = raw.cast("string")
    v, x = _amount(s)
    if min_value is not None:
        x = F.greatest(x, F.lit(str(min_value)).cast(EXACT))
    if max_value is not None:
        x = F.least(x, F.lit(str(max_value)).cast(EXACT))
    zero = F.lit(0).cast("long" if kind == INTEGER else MONEY)
    return (F.when(raw.isNull() | (s == "") | (v == ""), zero)
            .otherwise(F.coalesce(to_kind(x, kind), zero)))


def parse_number_null(raw: Column, kind: str) -> Column:
    """Strip quotes and blanks; '' or not a number -> NULL."""
    v = F.trim(F.regexp_replace(raw.cast("string"), r'^"+|"+$', ""))
    return to_kind(number(v), kind)


def parse_number_coerce(raw: Column, kind: str) -> Column:
    """Plain numeric parse, failure -> NULL."""
    return to_kind(number(F.trim(raw.cast("string"))), kind)
