"""Records of quoted files, found in parallel.

A quoted field may hold line breaks, so where a record ends depends on all the
text before. Each line is a small automaton: from a record's start it ends
outside or inside a quoted field, and likewise from inside one. Those transfer
functions are combined associatively, first within each block of a file, then
over a file's blocks, so every line's state is known without one task reading
a file. Only lines with a quote take part, as narrow rows; a line without one
changes nothing.

A quote that opens a field is *stray* when its field does not end as a field
should: no closing quote comes before the file ends, the next one is not
followed by a delimiter or a line end (it opens another field), or the record
so made would have more fields than the header. That is decided for each
opening line from the next lines alone, whatever the state, so one stray quote
costs nothing but its own line: the line is kept, its stray quote is text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from settlekit.session import checkpoint_dir

QUOTE = '"'
#: States of the walk along a line: outside a quoted field, inside, and just
#: after a quote that may close the field or be the first of a doubled one.
_OUT, _IN, _MAYBE = 0, 1, 2


def _walk(line: Column, sep: str, inside: bool) -> Column:
    """(state, bad, delims, open) at the end of a line that starts outside or
    inside a quoted field: ``bad`` when a closing quote has text after it,
    ``delims`` outside quotes, ``open`` the place of the last opening quote."""
    start = F.struct(F.lit(_IN if inside else _OUT).alias("state"), F.lit(False).alias("field"), F.lit(False).alias("bad"),
                     F.lit(0).alias("delims"), F.lit(0).alias("open"), F.lit(-1).alias("at"))

    def step(acc: Column, seg: Column) -> Column:
        first = acc["at"] < 0
        opens = (acc["state"] == _OUT) & acc["field"] & ~first
        # the quote before this stretch of text
        after = (F.when(first, acc["state"]).when(opens, _IN).when(acc["state"] == _OUT, _OUT)
                 .when(acc["state"] == _IN, _MAYBE).otherwise(_IN))
        tail = (after == _MAYBE) & (seg != "")
        state = F.when(tail, _OUT).otherwise(after)
        n = F.length(seg) - F.length(F.replace(seg, F.lit(sep), F.lit("")))
        return F.struct(
            state.alias("state"), ((state == _OUT) & (F.endswith(seg, F.lit(sep)) | (first & (seg == "")))).alias("field"),
            (acc["bad"] | (tail & ~F.startswith(seg, F.lit(sep)))).alias("bad"),
            (acc["delims"] + F.when(state == _OUT, n).otherwise(0)).alias("delims"),
            F.when(opens, acc["at"]).otherwise(acc["open"]).alias("open"), (acc["at"] + F.length(seg) + 1).alias("at"))

    return F.aggregate(F.split(line, QUOTE), start, step)


def listed_path() -> Column:
    """The path as a listing shows it (not percent-encoded, file:/ with one slash)."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(path, "^file:/+", "file:/")


def files_by_quoting(spark: SparkSession, paths: list[str], sep: str) -> tuple[list[str], list[str]] | None:
    """(plain, spanning) files: in spanning ones some line leaves a quoted field
    open. None where there are none, the usual case; one distributed pass."""
    v = F.col("value")
    text = spark.read.text(paths).select(listed_path().alias("file"), v)
    opens = F.when(v.rlike(f'(^|[{sep}])"'), _walk(v, sep, False)["state"] == _IN).otherwise(False)
    spanning = {r["file"] for r in text.where(opens).select("file").distinct().collect()}   # paths only, as in the listing
    if not spanning:
        return None
    every = {r["file"] for r in spark.read.text(paths).select(listed_path().alias("file")).distinct().collect()}
    return sorted(every - spanning), sorted(spanning)


def _lines(spark: SparkSession, files: list[str], sep: str, staging: str) -> DataFrame:
    """Lines of the files as a written table: file, block, number (consecutive
    within the block), text, its line end, and the two walks of a line with a
    quote. Written, so that numbers stay what they are."""
    read = spark.read.option("lineSep", "\n").text(files).select(
        listed_path().alias("file"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"), "value")
    # a carriage return ends a line too; before a line feed it belongs to it
    parts = F.split("value", "\r")
    pieces = F.when(F.contains("value", F.lit("\r")), F.transform(
        F.filter(parts, lambda p, i: (i < F.size(parts) - 1) | (p != "")), lambda p, i: F.struct(
            p.alias("text"), F.when(i < F.size(parts) - 2, "\r").when(i == F.size(parts) - 1, "\n")
            .otherwise(F.when(F.element_at(parts, -1) == "", "\r\n").otherwise("\r")).alias("end")))
    ).otherwise(F.array(F.struct(F.col("value").alias("text"), F.lit("\n").alias("end"))))
    cut = read.select("file", "name", "block", F.explode(pieces).alias("p")).select("file", "name", "block", "p.text", "p.end")
    quoted = F.contains("text", F.lit(QUOTE))
    cut.select("file", "name", "block", F.monotonically_increasing_id().alias("id"), "text", "end",
               F.when(quoted, _walk(F.col("text"), sep, False)).alias("n"),
               F.when(quoted, _walk(F.col("text"), sep, True)).alias("q")).write.parquet(staging)
    return spark.read.parquet(staging)


def _spans(lines: DataFrame, most_delims: int) -> tuple[DataFrame, DataFrame]:
    """(spans, strays): records of several lines, from (block, id) to (to_block,
    to_id) of a file, and lines with a stray opening quote."""
    place = F.struct("block", "id").alias("place")
    events = lines.where("n IS NOT NULL").select(
        "file", "block", "id", place, (F.col("n.state") == _IN).alias("opens"), F.col("n.delims").alias("n_delims"),
        (F.col("q.state") == _IN).alias("stays"), F.col("q.bad").alias("bad"), F.col("q.delims").alias("q_delims"))
    block = Window.partitionBy("file", "block")
    forward, before = block.orderBy("id"), block.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    later = block.orderBy(F.col("id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks, blocks_back = Window.partitionBy("file").orderBy("block"), Window.partitionBy("file").orderBy(F.col("block").desc())
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    following = blocks_back.rowsBetween(Window.unboundedPreceding, -1)

    # where the field of an opening line ends, and the fields the record has then
    summed = events.withColumn("sum", F.sum("q_delims").over(forward))
    ends = F.when(~F.col("stays"), F.struct("place", "bad", "sum"))
    by_block = summed.groupBy("file", "block").agg(F.sum("q_delims").alias("total"), F.min(ends).alias("first_end"))
    offset = F.coalesce(F.sum("total").over(earlier), F.lit(0))
    shifted = by_block.withColumn("offset", offset).withColumn("first_end", F.when(
        F.col("first_end").isNotNull(), F.struct(F.col("first_end.place").alias("place"), F.col("first_end.bad").alias("bad"),
                                                 (F.col("first_end.sum") + F.col("offset")).alias("sum"))))
    known = shifted.select("file", "block", "offset", F.last("first_end", ignorenulls=True).over(following).alias("next_end"))
    here = F.last(ends, ignorenulls=True).over(later)
    judged = summed.withColumn("own_end", here).join(known, ["file", "block"]).withColumn("end", F.when(
        F.col("own_end").isNotNull(), F.struct(F.col("own_end.place").alias("place"), F.col("own_end.bad").alias("bad"),
                                               (F.col("own_end.sum") + F.col("offset")).alias("sum"))).otherwise(F.col("next_end")))
    fields = F.col("n_delims") + F.col("end.sum") - F.col("sum") - F.col("offset")
    good = F.col("opens") & F.col("end").isNotNull() & ~F.coalesce(F.col("end.bad"), F.lit(True)) & (fields <= most_delims)

    # transfer functions: to inside always, to outside always, exchange, or nothing
    sure = F.when(F.col("good") & F.col("stays"), 1).when(~F.col("good") & ~F.col("stays"), 0)
    swaps = (F.col("good") & ~F.col("stays")).cast("int")
    typed = judged.withColumn("good", good).withColumns({"sure": sure, "swap": swaps})
    turned = typed.withColumn("turns", F.sum("swap").over(forward))
    fixed = F.when(F.col("sure").isNotNull(), F.struct("sure", F.col("turns").alias("turns")))
    local = turned.withColumns({"fixed": F.last(fixed, ignorenulls=True).over(before),
                                "own_turns": F.coalesce(F.sum("swap").over(before), F.lit(0))})
    whole = turned.groupBy("file", "block").agg(F.max(F.when(F.col("sure").isNotNull(), F.struct("id", "sure", "turns"))).alias("last"),
                                                F.sum("swap").alias("swaps"))
    running = whole.withColumn("turns", F.sum("swaps").over(blocks))
    # turns of the whole file up to the last sure line of the block
    at = F.when(F.col("last").isNotNull(), F.struct(F.col("last.sure").alias("sure"),
                                                    (F.col("turns") - F.col("swaps") + F.col("last.turns")).alias("turns")))
    entry = running.withColumn("at", at).select(
        "file", "block", F.last("at", ignorenulls=True).over(earlier).alias("at"),
        (F.col("turns") - F.col("swaps")).alias("turns_before"))
    start = F.pmod(F.coalesce(F.col("at.sure"), F.lit(0)) + F.col("turns_before") - F.coalesce(F.col("at.turns"), F.lit(0)), F.lit(2))
    states = local.join(entry.select("file", "block", start.alias("start")), ["file", "block"])
    state = F.pmod(F.coalesce(F.col("fixed.sure"), F.col("start")) + F.col("own_turns") - F.coalesce(F.col("fixed.turns"), F.lit(0)), F.lit(2))
    opened = states.where(F.col("opens")).where(state == 0)
    return (opened.where("good").select("file", "block", "id", F.col("end.place.block").alias("to_block"), F.col("end.place.id").alias("to_id")),
            opened.where("NOT good").select("file", "block", "id"))


def _literal(text: Column, open_at: Column, sep: str) -> Column:
    """A line with the quotes from a stray opening on as text: those fields are
    quoted anew, with their quotes doubled."""
    rest = F.split(F.expr("substr(text, open_at + 1)"), sep)
    again = F.transform(rest, lambda x: F.when(F.contains(x, F.lit(QUOTE)), F.concat(
        F.lit(QUOTE), F.replace(x, F.lit(QUOTE), F.lit(QUOTE * 2)), F.lit(QUOTE))).otherwise(x))
    return F.concat(F.expr("substr(text, 1, open_at)"), F.array_join(again, sep))


def read_records(spark: SparkSession, files: list[str], sep: str, n_fields: int, staging: str | None = None) -> DataFrame:
    """Every record of the files but their headers: (file, name, block, id,
    record, stray), placed at its first line. ``stray`` is the line as it stands
    of a record whose opening quote was read as text."""
    staging = staging or f"{checkpoint_dir(spark).rstrip('/')}/records/{uuid.uuid4().hex}"
    lines = _lines(spark, files, sep, staging)
    spans, strays = _spans(lines, n_fields - 1)
    spans_at, strays_at = f"{staging}-spans", f"{staging}-strays"
    spans.write.parquet(spans_at)
    strays.write.parquet(strays_at)
    spans, strays = spark.read.parquet(spans_at), spark.read.parquet(strays_at)
    # the lines of each span, block by block
    reach = lines.groupBy("file", "block").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    within = spans.withColumnsRenamed({"block": "at_block", "id": "at_id"}).join(reach, "file").where("block BETWEEN at_block AND to_block")
    members = within.select("file", "block", "at_block", "at_id", F.explode(F.sequence(
        F.when(F.col("block") == F.col("at_block"), F.col("at_id")).otherwise(F.col("lo")),
        F.when(F.col("block") == F.col("to_block"), F.col("to_id")).otherwise(F.col("hi")))).alias("id"))
    kept = lines.select("file", "name", "block", "id", "text", "end", F.col("n.open").alias("open_at"))
    marked = (kept.join(members, ["file", "block", "id"], "left")
              .join(strays.withColumn("stray", F.lit(True)), ["file", "block", "id"], "left"))
    alone = marked.where("at_id IS NULL").select(
        "file", "name", "block", "id", F.when(F.col("stray"), _literal(F.col("text"), F.col("open_at"), sep)).otherwise(F.col("text")).alias("record"),
        F.when(F.col("stray"), F.col("text")).alias("stray"))
    pieces = F.array_sort(F.collect_list(F.struct("block", "id", "text", "end")))
    # every line with its own end, but the last, whose end ends the record
    joined = marked.where("at_id IS NOT NULL").groupBy("file", "name", "at_block", "at_id").agg(pieces.alias("p")).select(
        "file", "name", F.col("at_block").alias("block"), F.col("at_id").alias("id"),
        F.array_join(F.transform("p", lambda x, i: F.concat(x["text"], F.when(i < F.size("p") - 1, x["end"]).otherwise(""))), "").alias("record"),
        F.lit(None).cast("string").alias("stray"))
    records = alone.unionByName(joined).where(F.trim("record") != "")
    head = lines.where(F.trim("text") != "").groupBy("file").agg(F.min(F.struct("block", "id")).alias("h"))
    heads = head.select("file", F.col("h.block").alias("block"), F.col("h.id").alias("id"))
    return records.join(heads, ["file", "block", "id"], "left_anti")


def parsed(records: DataFrame, sep: str, names: list[str], corrupt: str) -> DataFrame:
    """Columns of each record by Spark's own CSV parser, and ``corrupt``."""
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, corrupt])
    row = F.from_csv("record", schema, {
        "sep": sep, "quote": QUOTE, "escape": QUOTE, "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    return records.withColumn("_r", row).select(
        *[F.col("_r").getField(n).alias(n) for n in names], F.col("_r").getField(corrupt).alias(corrupt),
        F.col("file").alias("_source_file"), F.struct(F.col("name").alias("f"), F.col("block").alias("b"), F.col("id").alias("i")).alias("_ord"),
        F.col("stray").alias("_stray"))
