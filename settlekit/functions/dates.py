"""Date coercion as native expressions (P5, P6, time-only rule).

``try_to_timestamp`` is tried once per format, in order, inside one
``coalesce`` — the first format that parses wins, exactly like a loop of
``strptime`` attempts, but evaluated in generated code per batch.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: accepted layouts, in the order they are tried ----------------
# Default policy (day-first layouts before month-first ones). Single letters
# accept one or two digits, as Python's strptime does.
DEFAULT_FORMATS = [
    "yyyy-M-d", "d-M-yyyy", "yyyy/M/d", "d/M/yyyy",
    "yyyy-M-d H:m:s", "d-M-yyyy H:m:s", "yyyy/M/d H:m:s", "d/M/yyyy H:m:s",
    "yyyy-M-d H:m", "d-M-yyyy H:m", "yyyy/M/d H:m", "d/M/yyyy H:m",
    "yyyyMMdd", "ddMMyyyy", "M/d/yy H:m", "M/d/yyyy H:m",
]
# Null policy (month-first).
NULL_FORMATS = ["M/d/yy H:m", "M/d/yyyy H:m", "yyyy-M-d H:m:s"]
# Month names of the generic fallback, three letters each.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
# Date columns that get the run timestamp when the value is missing.
DEFAULTED_DATE_COLUMNS = ("return_date", "created_on", "upload_timestamp")
TIME_ONLY = r"^\d{2}:\d{2}\.0$"
# --- end fixed values -------------------------------------------------------------

TWO_DIGIT_YEAR = "yy"


def ts_lit(value: _dt.datetime | _dt.date | str) -> Column:
    """Timestamp literal read in the session time zone (never the Python
    process's local zone, which ``F.lit(datetime)`` would use)."""
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(value, _dt.date):
        value = value.strftime("%Y-%m-%d 00:00:00")
    return F.lit(value).cast("timestamp")


def _pivot_two_digit_year(t: Column) -> Column:
    """Two-digit years 69-99 belong to the 1900s (Python's %y rule);
    Spark's ``yy`` reads every two-digit year into 2000-2099."""
    return F.when(F.year(t) >= 2069, t - F.expr("INTERVAL 100 YEARS")).otherwise(t)


def shape_of(fmt: str) -> str:
    """A regex accepting every text the layout could parse (and more):
    a two-letter field is two digits, any other field one or more digits,
    other characters literal. Used to skip hopeless parse attempts, whose
    failure is expensive; the layout itself still decides."""
    out, i = [], 0
    while i < len(fmt):
        ch = fmt[i]
        if ch.isalpha():
            j = i
            while j < len(fmt) and fmt[j] == ch:
                j += 1
            out.append(r"\d{2}" if j - i == 2 else r"\d+")
            i = j
        else:
            out.append(re.escape(ch))
            i += 1
    return "^" + "".join(out) + "$"


def _try_format(v: Column, fmt: str) -> Column:
    t = F.when(v.rlike(shape_of(fmt)), F.try_to_timestamp(v, F.lit(fmt)))
    if TWO_DIGIT_YEAR in fmt and "yyyy" not in fmt:
        t = _pivot_two_digit_year(t)
    return t


# --- the grammar of free-form dates -------------------------------------------------
# A text is a date with, at its end, an optional clock: h:m, seconds, a fraction,
# am or pm, a zone. The date is what words and numbers are left without weekday
# names and ordinal endings: three numbers, or a month's name with one or two.
_MONTH_NAME = ("jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|"
               "oct(?:ober)?|nov(?:ember)?|dec(?:ember)?")
_WEEKDAY = r"\b(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\b[.,]?"
_BARE_HOUR = r"(^|[ t,])(\d{1,2}) ?([ap]\.?m\.?)(?= |$|[z+-])"
_CLOCK = (r"(?:^|[ t,]) ?(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:[.,](\d{1,9}))?)?"
          r"(?: ?([ap])\.?m\.?)?(?: ?(z|utc|gmt|[+-]\d{2}:?\d{2}))?$")
_DATE_TEXT = r"^[a-z0-9 ,./-]*$"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value bound once. Inlined, a table's date columns
    would be too much code."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _split_clock(text: Column) -> Column:
    """(date, clock fields, parts): ``parts`` are the words and numbers of the date."""
    t = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), _BARE_HOUR, "$1$2:00 $3")

    def cut(t: Column) -> Column:
        date = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, _CLOCK, ""), _WEEKDAY, " "), r"(\d)(?:st|nd|rd|th)\b", "$1")
        clock = F.array(*[F.regexp_extract(t, _CLOCK, i) for i in range(1, 7)])
        return F.struct(date.alias("date"), clock.alias("clock"), F.regexp_extract_all(date, F.lit(r"([a-z]+|\d+)"), F.lit(1)).alias("parts"))
    return _let(t, cut)


def _year_month_day(names: Column, numbers: Column) -> Column:
    """[year, month, day] as texts, by what kind of part stands where; with
    three numbers the month comes first, the day if the first is over 12."""
    n = lambda i: F.get(numbers, F.lit(i))
    size = lambda i: F.length(n(i))
    name = F.get(names, F.lit(0))
    month = ((F.instr(F.lit(MONTHS), F.left(name, F.lit(3))) + 2) / 3).cast("int").cast("string")
    count = F.size(numbers)
    named = (F.when((count == 2) & (size(0) == 4) & (size(1) <= 2), F.array(n(0), month, n(1)))
             .when((count == 2) & (size(0) <= 2) & size(1).isin(2, 4), F.array(n(1), month, n(0)))
             .when((count == 1) & (size(0) == 4), F.array(n(0), month, F.lit("1"))))
    day_first = n(0).cast("int") > 12
    plain = (F.when((count == 3) & (size(0) == 4) & (size(1) <= 2) & (size(2) <= 2), F.array(n(0), n(1), n(2)))
             .when((count == 3) & (size(0) <= 2) & (size(1) <= 2) & size(2).isin(2, 4),
                   F.array(n(2), F.when(day_first, n(1)).otherwise(n(0)), F.when(day_first, n(0)).otherwise(n(1))))
             .when((count == 1) & (size(0) == 8), F.array(n(0).substr(1, 4), n(0).substr(5, 2), n(0).substr(7, 2))))
    return F.when(F.size(names) == 0, plain).when((F.size(names) == 1) & name.rlike(f"^(?:{_MONTH_NAME})$"), named)


def _resolved(x: Column) -> Column:
    """The instant that date and clock fields name; NULL where there is none."""
    is_name = lambda p: p.rlike("^[a-z]")
    ymd = F.when(x["date"].rlike(_DATE_TEXT), _year_month_day(F.filter(x["parts"], is_name), F.filter(x["parts"], lambda p: ~is_name(p))))
    h, mi, s, fraction, half, zone = (F.get(x["clock"], F.lit(i)) for i in range(6))

    def made(f: Column) -> Column:
        y = F.get(f, F.lit(0))
        number = y.cast("int")
        year = F.when(F.length(y) == 4, number).when(number >= 69, number + 1900).otherwise(number + 2000)
        hour = F.when(h == "", 0).when(half == "", h.cast("int")).when(
            h.cast("int").between(1, 12), h.cast("int") % 12 + F.when(half == "p", 12).otherwise(0))
        seconds = F.concat(F.when(s == "", "0").otherwise(s), F.lit("."), F.rpad(F.left(fraction, F.lit(6)), 6, "0")).cast("decimal(8,6)")
        fields = [year, F.get(f, F.lit(1)).cast("int"), F.get(f, F.lit(2)).cast("int"), hour, F.when(mi == "", 0).otherwise(mi.cast("int")), seconds]
        offset = F.when(zone.isin("z", "utc", "gmt"), F.lit("+00:00")).otherwise(F.concat(zone.substr(1, 3), F.lit(":"), F.right(zone, F.lit(2))))
        # a leap second, or hour 24, names no instant
        sound = (hour < 24) & (F.length(s) <= 2) & (seconds < 60)
        return F.when(sound, F.when(zone == "", F.try_make_timestamp(*fields)).otherwise(F.try_make_timestamp(*fields, offset)))
    return F.when(ymd.isNotNull(), _let(ymd, made))


def fallback(v: Column) -> Column:
    """Generic parse of the spellings that no listed layout covers; NULL when
    none fits (see ``unread`` for counting those)."""
    return _let(_let(F.lower(F.trim(v)), _split_clock), _resolved)


def unread(raw: Column, parsed: Column) -> Column:
    """Does a date text fall through all layouts? (``parsed``: by P6)"""
    return raw.isNotNull() & (F.trim(raw.cast("string")) != "") & parsed.isNull()


def time_only(v: Column, run_ts: Column) -> Column:
    """``MM:SS.0`` -> the run day at hour = minutes / 60, minute = minutes % 60,
    second = seconds (seconds parsed as digits, not by stripping zeros)."""
    minutes = F.regexp_extract(v, r"^(\d{2}):", 1).try_cast("int")
    seconds = F.regexp_extract(v, r":(\d{2})\.0$", 1).try_cast("int")
    return F.when(v.rlike(TIME_ONLY) & (F.floor(minutes / 60) < 24) & (seconds < 60),
                  F.try_make_timestamp(F.year(run_ts), F.month(run_ts), F.dayofmonth(run_ts),
                                       F.floor(minutes / 60).cast("int"), minutes % 60, seconds))


def parse_date_default(raw: Column, column: str, run_ts: Column) -> Column:
    """P5: missing -> run_ts for the defaulted columns else NULL; time-only;
    16 layouts in order; generic parse; anything else -> run_ts."""
    v = F.trim(raw.cast("string"))
    missing = raw.isNull() | (raw.cast("string") == "")
    on_missing = run_ts if column in DEFAULTED_DATE_COLUMNS else F.lit(None).cast("timestamp")
    parsed = F.coalesce(time_only(v, run_ts), *[_try_format(v, f) for f in DEFAULT_FORMATS],
                        v.try_cast("timestamp"), fallback(v), run_ts)
    # A value of blanks is not "missing" but parses to nothing (NULL).
    return F.when(missing, on_missing).when(v == "", F.lit(None).cast("timestamp")).otherwise(parsed)


def parse_date_null(raw: Column, run_ts: Column) -> Column:
    """Strip quotes; time-only; three month-first layouts; generic cast;
    failure -> NULL."""
    v = F.trim(F.regexp_replace(raw.cast("string"), r'^"+|"+$', ""))
    return F.coalesce(time_only(v, run_ts), *[_try_format(v, f) for f in NULL_FORMATS],
                      v.try_cast("timestamp"), fallback(v))


def parse_date_coerce(raw: Column) -> Column:
    """Generic parse, failure -> NULL."""
    v = F.trim(raw.cast("string"))
    return F.coalesce(v.try_cast("timestamp"), fallback(v))


def unread_date(raw: Column, column: str, policy: str, run_ts: Column) -> Column:
    """Is there a text that the policy's parse can't read as a date?"""
    v = F.trim(raw.cast("string"))
    if policy == "default":
        never = F.lit(None).cast("timestamp")
        parsed = F.coalesce(time_only(v, run_ts), parse_date_default(raw, column, never))
    else:
        parsed = parse_date_null(raw, run_ts) if policy == "null" else parse_date_coerce(raw)
    return unread(raw, parsed)
