"""Personal data: fixed patterns plus bootstrapped contextual extraction
(DataFrame functions only).

Base spans come from one regular expression per kind, leftmost and not
overlapping, with checks on the match (part values, digit counts, Luhn). They
are the seeds. An *instance* is an identifier-like token (it holds a digit or
``@``); a *pattern* is the text just left of it: a ``key=`` / ``key:`` prefix
of the token itself or else the word before it, digits written as 9. Rounds
over the pattern-instance graph, grouped and joined by Spark:

* a pattern's confidence for a kind is the share of its instances that are
  known to be of that kind (known: seed, or accepted in an earlier round),
* a pattern with at least ``min_support`` different known instances and a
  confidence of ``min_confidence`` or more accepts its unknown instances, when
  they have ``min_digits`` digits or an ``@``; an instance accepted for several
  kinds goes to the kind with the higher confidence, then the earlier kind.

Accepted instances become spans wherever they occur as a token after an
accepted pattern, unless they overlap a base span. Base spans always stay.

Defined results: null text counts as empty; offsets are code points, end
exclusive; equal rows have equal results; a text without identifiers has no
spans; an empty table gives an empty one. Columns other than those named here
are kept unless an output column has the name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from settlekit.llm.common import fresh_columns, plain_columns, row_key, written

KINDS = ("email", "ip", "card", "phone")

# What each kind matches. Lookbehinds and possessive repeats change no match:
# a match can only begin at the start of a run of its characters (or where the
# previous match ended, \G), and without them one long run costs its square.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: a text without a match of this has none of the kind
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
#: matches placed together (see ``located``)
RUN = 256
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does a digit string pass the Luhn check?"""
    def value(d: Column, i: Column) -> Column:
        n = d.cast("int")
        twice = n * 2
        return F.when(i % 2 == 0, n).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    each = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), value)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":  # leading zeros allowed; long digit runs are over 255
        return F.forall(F.split(m, r"\.", -1), lambda p: F.char_length(F.regexp_replace(p, "^0+(?=[0-9])", "")).between(1, 3)
                        & (F.coalesce(F.substr(F.regexp_replace(p, "^0+(?=[0-9])", ""), F.lit(1), F.lit(4)).cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        n = F.char_length(_digits(m))
        return F.when(n.between(13, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.char_length(_digits(m)).between(9, 15)
    return F.lit(True)


def located(text: Column, pattern: str, left: int = 0) -> Column:
    """Matches with their places: array of (start, end, m[, before]).

    The text between matches comes from ``split`` with the same pattern, so
    places are running sums of lengths; ``before`` holds up to ``left``
    characters in front of the match, not reaching into the match before it.
    """
    gaps = F.split(text, pattern, -1)
    both = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    kind = "struct<start:int,end:int,m:string" + (",before:string>" if left else ">")
    none = F.array().cast(f"array<{kind}>")

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["g"])
        end = begin + F.char_length(x["m"])
        fields = [begin.alias("start"), end.alias("end"), x["m"].alias("m")]
        if left:
            fields.append(F.right(x["g"], F.lit(left)).alias("before"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(*fields))).alias("out"))

    # Growing an array copies it, so matches are placed in runs of RUN: a run's
    # length moves the next one, and no array grows with the text but these.
    def placed(real: Column) -> Column:
        runs = F.when(F.size(real) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(real) - 1) / RUN).cast("int")),
                                                    lambda i: F.slice(real, i * RUN + 1, RUN)))

        def laid(parts: Column) -> Column:
            length = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + F.char_length(x["g"]) + F.char_length(x["m"])))
            starts = F.aggregate(length, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
            return F.flatten(F.zip_with(parts, F.slice(starts, 1, F.size(parts)), lambda p, at: F.aggregate(
                p, F.struct(at.alias("at"), none.alias("out")), add, lambda acc: acc["out"])))
        return F.get(F.transform(F.array(runs), laid), F.lit(0))

    real = F.filter(both, lambda x: x["m"].isNotNull())
    return F.coalesce(F.get(F.transform(F.array(real), placed), F.lit(0)), none)


def base_spans(text: Column) -> Column:
    """Valid base spans of a text: array of (kind index, start, end)."""
    empty = F.array().cast("array<struct<k:int,start:int,end:int>>")
    parts = []
    for k, kind in enumerate(KINDS):
        ok = F.filter(located(text, PATTERNS[kind]), lambda x: _valid(kind, x["m"]))  # noqa: B023 - called at once
        spans = F.transform(ok, lambda x: F.struct(F.lit(k).alias("k"), x["start"].alias("start"), x["end"].alias("end")))  # noqa: B023
        parts.append(F.when(text.rlike(HINTS[kind]), spans).otherwise(empty))
    return F.concat(*parts)


def _pattern(token: Column, before: Column) -> Column:
    """Lexical context of a token: its own key, else the word before it."""
    own = F.regexp_extract(token, r"^([^\s0-9@=:]{2,32}+[=:])", 1)
    word = F.regexp_extract(before, r"(?<!\S)(\S++)\s*+$", 1)
    used = F.when(own != "", own).otherwise(word)
    return F.regexp_replace(F.lower(used), "[0-9]+", "9")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` by kind as listed, then start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", F.get(names, x["k"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, text: str = "text", rounds: int = 3, min_support: int = 5,
             min_confidence: float = 0.8, min_digits: int = 4) -> DataFrame:
    """``docs`` without the text, plus ``base`` and ``spans`` (arrays of kind
    index, start, end) for every row."""
    docs = fresh_columns(docs, "base", "spans")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keys = dict(zip(("__r1", "__r2"), row_key(*plain_columns(docs))))
    empty = F.array().cast("array<struct<start:int,end:int,m:string,before:string>>")
    found = docs.withColumns(keys).select(
        *[F.col(f"`{c}`") for c in docs.columns if c != text], "__r1", "__r2", base_spans(t).alias("base"),
        F.when(t.rlike("[0-9@]"), located(t, TOKEN, left=64)).otherwise(empty).alias("__tokens"))
    found = written(found, "pii-found")

    token = F.col("x.m")
    core = F.regexp_replace(F.regexp_replace(token, r"^[^\s0-9@=:]{2,32}+[=:]", ""), r"^[\"'(\[<]+|[\"')\]>.,;:!?]+$", "")
    seen = (found.where(F.size("__tokens") > 0)
            .select("__r1", "__r2", "base", F.explode("__tokens").alias("x"))
            .select("__r1", "__r2", F.col("x.start").alias("start"), F.col("x.end").alias("end"),
                    _pattern(token, F.col("x.before")).alias("pattern"), core.alias("instance"),
                    F.array_min(F.transform(F.filter("base", lambda b: (b["start"] < F.col("x.end")) & (F.col("x.start") < b["end"])), lambda b: b["k"])).alias("seed")))
    seen = written(seen.where(F.col("pattern") != ""), "pii-tokens")
    # the graph: one edge for each pair, however often a copied text repeats it
    edges = seen.groupBy("pattern", "instance").agg(F.min("seed").alias("seed"))
    edges = written(edges, "pii-edges")
    known = edges.where(F.col("seed").isNotNull()).groupBy("instance").agg(F.min("seed").alias("k"))
    likely = (F.char_length(_digits(F.col("instance"))) >= min_digits) | F.col("instance").contains("@")
    accepted = None
    for _ in range(rounds):
        state = edges.join(known, "instance", "left")
        totals = state.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
        scored = (state.where(F.col("k").isNotNull()).groupBy("pattern", "k").agg(F.count(F.lit(1)).alias("hits"))
                  .join(totals, "pattern").withColumn("confidence", F.col("hits") / F.col("n"))
                  .where((F.col("hits") >= min_support) & (F.col("confidence") >= min_confidence)))
        best = scored.groupBy("pattern").agg(F.max(F.struct("confidence", (-F.col("k")).alias("k"))).alias("b")).select("pattern", (-F.col("b.k")).alias("pk"), "b.confidence")
        accepted = written(best, "pii-patterns")
        new = (state.where(F.col("k").isNull() & likely).join(accepted, "pattern")
               .groupBy("instance").agg(F.max(F.struct("confidence", (-F.col("pk")).alias("k"))).alias("b")).select("instance", (-F.col("b.k")).alias("k")))
        before = known
        known = written(before.unionByName(new), "pii-known")
        if new.isEmpty():
            break
    added = seen.where(F.col("seed").isNull() & likely)
    if accepted is None:
        added = added.where(F.lit(False)).withColumn("pk", F.lit(0))
    else:
        added = added.join(accepted, "pattern").join(known.select("instance", "k"), "instance").where(F.col("k") == F.col("pk"))
    extra = added.groupBy("__r1", "__r2").agg(F.collect_set(F.struct(F.col("pk").alias("k"), "start", "end")).alias("extra"))
    out = found.drop("__tokens").join(extra, ["__r1", "__r2"], "left")
    return out.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast("array<struct<k:int,start:int,end:int>>"))))).drop("extra", "__r1", "__r2")
