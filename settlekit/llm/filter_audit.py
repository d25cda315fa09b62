"""Audit of how document filters interact, over every order of applying them.

Each document becomes a mask of the filters it fails; a table of documents
becomes a few cells (part, mask, labels) with a count. A cell folds across the
array of all filter orders and gives, for every (order, step), a struct of
counts, weighted by the cell's documents; the structs of a part's cells are
summed element by element. Everything is DataFrame expressions.

Defined results: a null text is the empty text, a null language the part ``''``;
repeated rows count as often as they occur; a document without an id is no
copy of another and makes none; several labels of one document count as good
(toxic) if any row says so; an empty table has no parts and gives no rows;
other columns are not read, whatever their names. Whole texts are read.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from settlekit.llm.common import written

#: The filters, by letter; bit i of a mask is set where filter i is failed.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PCT, MAX_CAPITALS_PCT = 200, 50, 3
SYMBOLS = r"[#$%&*|]"

#: What is counted at each step of each order, in the order of the struct.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def words(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space."""
    blank = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    # no lambda here: equal expressions without one are evaluated once a row
    return F.array_remove(F.split(blank, " "), "")


def failures(text: Column) -> dict[str, Column]:
    """Failure conditions that a text alone decides."""
    w = words(text)
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]", ""))
    return {"A": F.size(w) < MIN_WORDS,
            "B": F.size(F.array_distinct(w)) * 100 < F.size(w) * MIN_DISTINCT_PCT,
            "C": capitals.cast("long") * 100 > F.char_length(text).cast("long") * MAX_CAPITALS_PCT,
            "D": text.rlike(SYMBOLS)}


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, weight): documents that agree in all four are
    one row here for each (id, text), with their number as weight.

    A copy is a document whose (text digest, id) is not the smallest of its
    digest. That pair is the join key, never the digest alone, so a text shared
    by a third of all rows is no hot key; repeated rows were counted before."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("text"))
    own = failures(F.col("text"))
    bits = reduce(lambda a, b: a + b, [F.when(own[f], 1 << FILTERS.index(f)).otherwise(0) for f in "ABCD"])
    # written: two steps read these short rows, the texts are read once
    rows = written(read.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.alias("mask"))
                   .groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("weight")), "filter-masks")
    first = (rows.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
             .withColumn("is_first", F.lit(True)))
    judged = (labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")))
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return (rows.join(first, ["doc_id", "digest"], "left").join(judged, "doc_id", "left")
            .select("part", (F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"),
                    F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "weight"))


def cells(marked: DataFrame) -> DataFrame:
    """One row for each (part, mask, good, toxic) with its documents: at most
    32 x 4 cells a part, whatever the number of documents."""
    return marked.groupBy("part", "mask", "good", "toxic").agg(F.sum("weight").alias("weight"))


def order_array() -> Column:
    """Every order of the filters as an array of bit numbers: 120 x 5 constants
    that Spark broadcasts to the tasks with their plan."""
    return F.array(*[F.array(*[F.lit(FILTERS.index(f)) for f in p]) for p in permutations(FILTERS)])


def _step(mask: Column, bit: Column, seen: Column, good: Column, toxic: Column, weight: Column) -> Column:
    """Counts of one cell at one step: ``seen`` is the mask of filters applied before."""
    own = F.call_function("shiftleft", F.lit(1), bit)
    fails, gone = mask.bitwiseAND(own) != 0, mask.bitwiseAND(seen) != 0
    removed = fails & ~gone
    holds = {"kept": ~fails & ~gone, "removed": removed, "redundant": fails & gone, "unique_fails": mask == own,
             "good_lost": removed & good, "toxic_lost": removed & toxic}
    return F.struct(*[F.when(holds[c], weight).otherwise(F.lit(0)).cast("long").alias(c) for c in COUNTS])


def folded(cell: DataFrame) -> DataFrame:
    """Each cell's fold over the orders: an array of 600 weighted structs, order
    by order and step by step."""
    c = {k: F.col(k) for k in ("mask", "good", "toxic", "weight")}
    none = F.array().cast("array<struct<" + ",".join(f"{k}:bigint" for k in COUNTS) + ">>")

    def walk(order: Column) -> Column:
        start = F.struct(F.lit(0).alias("seen"), none.alias("out"))
        return F.aggregate(order, start, lambda acc, bit: F.struct(
            acc["seen"].bitwiseOR(F.call_function("shiftleft", F.lit(1), bit)).alias("seen"),
            F.concat(acc["out"], F.array(_step(c["mask"], bit, acc["seen"], c["good"], c["toxic"], c["weight"]))).alias("out")),
            lambda acc: acc["out"])

    return cell.withColumn("steps", F.flatten(F.transform(order_array(), walk)))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step, with the counts of that step and
    the filter's removals over all orders (``shapley``)."""
    per_cell = folded(cells(masks(docs, labels)))
    # at most 128 cells a part, each with 600 structs
    held = per_cell.groupBy("part").agg(F.collect_list("steps").alias("all"))
    total = F.aggregate(F.slice("all", 2, 128), F.col("all")[0], lambda acc, x: F.zip_with(
        acc, x, lambda a, b: F.struct(*[(a[k] + b[k]).alias(k) for k in COUNTS])))
    summed = held.select("part", total.alias("total"))
    orders = order_array()
    bit_at = F.flatten(orders)
    # removals of one filter over all orders and steps
    removed = F.array(*[F.aggregate(F.zip_with("total", bit_at, lambda s, b: F.when(b == i, s["removed"]).otherwise(F.lit(0).cast("long"))),  # noqa: B023
                                    F.lit(0).cast("long"), lambda a, x: a + x) for i in range(len(FILTERS))])
    out = summed.select("part", removed.alias("by_filter"), F.posexplode("total").alias("at", "s"))
    n = len(FILTERS)
    order = F.element_at(orders, (F.col("at") / n).cast("int") + 1)
    letters = F.array(*[F.lit(f) for f in FILTERS])
    step = F.col("at") % n
    return out.select("part", F.array_join(F.transform(order, lambda b: F.element_at(letters, b + 1)), "").alias("filter_order"),
                      (step + 1).cast("int").alias("step"), *[F.col("s")[k].alias(k) for k in COUNTS],
                      F.element_at("by_filter", F.element_at(order, step + 1) + 1).alias("shapley"))
