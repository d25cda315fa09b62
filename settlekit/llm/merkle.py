"""Merkle manifest of a dataset: a tree over each source, a tree over sources.

Leaves of a source ascend by id; while several nodes remain, every three
consecutive ones become the digest of their concatenation. Trees are kept as
*packs*: ``HEIGHT`` levels of one subtree below each other, a record (digest,
children) for each node, the pack addressed by its top digest. A store of packs
is content-addressed: no record knows its place.

Proofs are found by descent. The requests of all leaves that share their upper
rank digits travel together, as one row with that digit prefix, so nobody joins
the root a million times: a row looks up the pack of the digest it stands at,
follows the rank's next base-3 digits, collects the children that it does not
select, and fans out into one row for each node at the pack's foot. Segments
come top-down and are reversed in the end, where the requests of one lowest pack
(at most 3^HEIGHT leaves) meet their path and are folded. Rows moved are n for
the leaves and n / 3^HEIGHT for each further step.

Ranks are global by source without one task seeing a source: rows are sorted by
range of (source, id, leaf, a tie-breaker), numbered within each range, and the
counts of earlier ranges are added.

Defined results: each null field is ``-``; a null source is a source of its own,
before all others; rows with a null id come first in their source and are never
tampered; rows that share an id ascend by leaf digest, and equal rows are equal
leaves with a place, and a proof, each; an empty table has no tree and gives no
rows; other columns are not read. Whole texts are hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from settlekit.llm.common import written

ARITY = 3
#: Levels in a pack: 3^6 = 729 leaves, about 1,100 digests.
HEIGHT = 6
WIDTH = ARITY ** HEIGHT

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(fields: dict[str, Column]) -> Column:
    """H of every field as UTF-8 length, colon and value, null as ``-``."""
    def framed(c: Column) -> Column:
        v = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return digest(*[framed(fields[f]) for f in FIELDS])


def leaves(docs: DataFrame) -> DataFrame:
    """(source, doc_id, leaf, shown): ``shown`` is the leaf of the row as a
    reader finds it, tampered for every second checksum of the id."""
    f = {c: F.col(f"`{c}`") for c in FIELDS}
    tampered = F.crc32(f["doc_id"].cast("string").cast("binary")) % 2 == 0
    cut = {**f, "text": F.replace(f["text"], F.lit("\n"), F.lit(""))}
    holds = tampered & F.contains(f["text"], F.lit("\n"))
    leaf = leaf_digest(f)
    return docs.select(f["source"].alias("source"), f["doc_id"].alias("doc_id"), leaf.alias("leaf"),
                       F.when(holds, leaf_digest(cut)).otherwise(leaf).alias("shown"))


def ranked(rows: DataFrame, group: str, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """``rows`` with ``rank`` (from 0 within the group) and ``size`` of the group.

    The range of a row is written with it, so a recomputed task can't deal the
    rows anew. A group holds as many ranges as it needs; its numbering adds the
    counts of the ranges before, of which there are few."""
    parts = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal rows may stand in any order, so a hash of the row number may split them
    spread = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    keys = [F.col(group).asc_nulls_first(), *order]
    placed = written(spread.repartitionByRange(parts, *keys, F.col("_tie")).withColumn("_range", F.spark_partition_id()), name)
    counts = placed.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    by_group = Window.partitionBy(group)
    before = counts.select(F.col(group).alias("_g"), F.col("_range").alias("_r"),
                           (F.sum("_n").over(by_group.orderBy("_range")) - F.col("_n")).alias("_before"),
                           F.sum("_n").over(by_group).alias("size"))
    local = placed.withColumn("_local", F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order, "_tie")) - 1)
    joined = local.join(before, local[group].eqNullSafe(before["_g"]) & (local["_range"] == before["_r"]))
    return joined.withColumn("rank", F.col("_local") + F.col("_before")).drop("_g", "_r", "_range", "_local", "_before", "_tie")


def _levels_above(size: Column) -> Column:
    """Levels between ``size`` nodes and their single top: how often a third,
    rounded up, must be taken until one is left (0 for one node)."""
    powers = F.array(*[F.lit(ARITY ** k).cast("long") for k in range(40)])
    return F.size(F.filter(powers, lambda p: p < size))


def _grown(feet: Column, levels: Column) -> Column:
    """Levels of a pack, from its foot up to its top: arrays of digests."""
    def parents(row: Column) -> Column:
        runs = F.sequence(F.lit(0), ((F.size(row) - 1) / ARITY).cast("int"))
        return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(row, i * ARITY + 1, ARITY), ""), 256))
    steps = F.slice(F.array(*[F.lit(i) for i in range(HEIGHT)]), 1, levels)
    return F.aggregate(steps, F.array(feet), lambda acc, _: F.concat(acc, F.array(parents(F.element_at(acc, -1)))))


def _records(levels: Column) -> Column:
    """The pack's rows above its foot, from the foot up: each a list of (digest,
    children) records."""
    def row(i: Column) -> Column:
        below = F.element_at(levels, i)
        return F.transform(F.element_at(levels, i + 1), lambda d, j: F.struct(
            d.alias("digest"), F.slice(below, j * ARITY + 1, ARITY).alias("children")))
    top = F.size(levels)
    return F.when(top > 1, F.transform(F.sequence(F.lit(1), F.greatest(top - 1, F.lit(1))), row)).otherwise(
        F.array().cast("array<array<struct<digest:string,children:array<string>>>>"))


def plant(nodes: DataFrame, group: str, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """Trees over ``nodes`` (group, rank, size, digest): (tops, packs by stage).

    ``tops`` has (group, digest); the packs of stage s hold the levels from
    s * HEIGHT on, in columns group, rank (of the pack in its stage), digest
    and records. A stage groups rows by rank div 3^HEIGHT, so the largest group
    is WIDTH digests long; stages are few, log base 729 of the largest group."""
    most = nodes.agg(F.max("size")).first()[0] or 0
    level, stages = nodes.select(group, "rank", "digest", _levels_above(F.col("size")).alias("left")), []
    while True:
        block = F.floor(F.col("rank") / WIDTH).cast("long").alias("rank")
        packed = (level.groupBy(group, block, "left").agg(F.collect_list(F.struct("rank", "digest")).alias("feet"))
                  .withColumn("feet", F.transform(F.array_sort("feet"), lambda x: x["digest"]))
                  .withColumn("levels", _grown(F.col("feet"), F.least(F.col("left"), F.lit(HEIGHT)))))
        made = written(packed.select(group, "rank", "left", F.element_at(F.element_at("levels", -1), 1).alias("digest"),
                                     _records(F.col("levels")).alias("records")), f"{name}-packs{len(stages)}")
        stages.append(made)
        most = -(-most // WIDTH)
        level = made.select(group, "rank", "digest", F.greatest(F.col("left") - HEIGHT, F.lit(0)).alias("left"))
        if most <= 1:
            return level.select(group, "digest"), stages


def _descended(records: Column, top: Column) -> Column:
    """Every path through a pack: an array of (offset at the foot, digest,
    segment), where a segment lists (digit, siblings) from the foot up."""
    segment = "array<struct<digit:int,siblings:array<string>>>"
    start = F.array(F.struct(F.lit(0).alias("offset"), top.alias("digest"), F.array().cast(segment).alias("segment")))

    def below(row: Column):
        def fan(at: Column) -> Column:
            children = F.element_at(row, at["offset"] + 1)["children"]
            return F.transform(children, lambda d, i: F.struct(
                (at["offset"] * ARITY + i).alias("offset"), d.alias("digest"),
                F.concat(F.array(F.struct(i.alias("digit"), F.filter(children, lambda _, j: j != i).alias("siblings"))), at["segment"]).alias("segment")))
        return fan
    return F.aggregate(F.reverse(records), start, lambda acc, row: F.flatten(F.transform(acc, below(row))))


def descend(asked: DataFrame, group: str, stages: list[DataFrame], name: str, foot: int = 0) -> DataFrame:
    """Follow the digits of every rank from each group's top down to the packs
    of stage ``foot``: (group, rank of the pack, digest, path above it).

    ``asked`` is (group, digest of its top, path above it). Packs are found by
    digest alone; equal subtrees are one record, looked up by each place."""
    at = asked.withColumn("rank", F.lit(0).cast("long"))
    for stage in range(len(stages) - 1, foot, -1):
        store = stages[stage].select("digest", "records").dropDuplicates(["digest"])
        fanned = at.join(store, "digest").select(
            group, "path", F.col("rank").alias("upper"), F.explode(_descended(F.col("records"), F.col("digest"))).alias("n"))
        at = written(fanned.select(group, F.col("n.digest").alias("digest"), F.concat("n.segment", "path").alias("path"),
                                   (F.col("upper") * WIDTH + F.col("n.offset")).alias("rank")), f"{name}-at{stage}")
    return at


def fold(shown: Column, path: Column) -> Column:
    """The root that a leaf and its path (from the leaf up) lead to."""
    return F.aggregate(path, shown, lambda cur, s: F.sha2(F.concat(
        F.array_join(F.slice(s["siblings"], 1, s["digit"]), ""), cur,
        F.array_join(F.slice(s["siblings"], s["digit"] + 1, ARITY), "")), 256))


def proof_text(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.array_join(s["siblings"], "")), "")


def manifest(docs: DataFrame) -> DataFrame:
    """One row for each document: its leaf, subroot, root and proof, and whether
    the document as shown leads to the root."""
    spark = docs.sparkSession
    placed = written(ranked(leaves(docs), "source", [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()], "merkle-leaves"), "merkle-ranked")
    subroots, packs = plant(placed.withColumnRenamed("leaf", "digest"), "source", "merkle")
    # the tree over sources: the same with one group
    tops = ranked(subroots.select(F.lit(0).alias("all"), "source", F.col("digest")), "all", [F.col("source").asc_nulls_first()], "merkle-sources")
    tops = written(tops, "merkle-tops")
    root, upper = plant(tops, "all", "merkle-upper")
    none = F.array().cast("array<struct<digit:int,siblings:array<string>>>")
    heads = descend(root.withColumn("path", none), "all", upper, "merkle-upper")
    # the lowest packs of the upper tree fan out to subroots
    store = upper[0].select("digest", "records").dropDuplicates(["digest"])
    fanned = heads.join(store, "digest").select(
        F.col("rank").alias("block"), "path", F.explode(_descended(F.col("records"), F.col("digest"))).alias("n"))
    found = fanned.select((F.col("block") * WIDTH + F.col("n.offset")).alias("rank"), F.col("n.digest").alias("digest"),
                          F.concat("n.segment", "path").alias("path"))
    asked = found.join(tops.select("rank", "source"), "rank").select("source", "digest", "path")
    at = descend(written(asked, "merkle-asked"), "source", packs, "merkle")
    # requests of one lowest pack, in rank order, meet the pack at the end of their descent
    block = F.floor(F.col("rank") / WIDTH).cast("long").alias("block")
    requests = (placed.groupBy("source", block).agg(F.collect_list(F.struct("rank", "doc_id", "leaf", "shown")).alias("asked"))
                .withColumnRenamed("source", "of"))
    top = root.select(F.col("digest").alias("root"))
    subs = subroots.select(F.col("source").alias("_s"), F.col("digest").alias("subroot"))
    paths = at.join(packs[0].select("digest", "records").dropDuplicates(["digest"]), "digest")
    met = requests.join(paths, requests["of"].eqNullSafe(paths["source"]) & (requests["block"] == paths["rank"]))
    met = met.join(subs, met["of"].eqNullSafe(subs["_s"]))
    each = met.select("subroot", "path", F.explode(F.arrays_zip(
        F.array_sort("asked").alias("request"), _descended(F.col("records"), F.col("digest")).alias("found"))).alias("z"))
    whole = F.concat("z.found.segment", "path")
    out = each.select(F.col("z.request.doc_id").alias("doc_id"), F.col("z.request.leaf").alias("leaf"), "subroot",
                      F.sha2(proof_text(whole), 256).alias("proof_sha256"), fold(F.col("z.request.shown"), whole).alias("folded_root"))
    only = root.first()
    if only is None:
        return spark.createDataFrame([], SCHEMA)
    return out.select("doc_id", "leaf", "subroot", F.lit(only["digest"]).alias("root"), "proof_sha256", "folded_root",
                      (F.col("folded_root") == only["digest"]).alias("verified"))


SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
