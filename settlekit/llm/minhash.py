"""Near-duplicate detection with ProbMinHash signatures, banding and exact
verification.

A text's five-word shingles are weighted by 1 + ln(count). Every shingle is a
Poisson process of rate weight, seeded by the shingle: its arrivals fall into
random registers, and each register keeps the shingle of the earliest arrival.
A shingle stops as soon as its next arrival comes later than the latest
register (early termination). Two texts agree in a register with probability
equal to their probability Jaccard. A text that repeats a shingle has the bands of its
registers at weight 1 as well, which agree with the Jaccard of distinct shingles.

Equal texts are one node. Nodes that share a band (``rows`` registers) become
candidates, but never all pairs of a bucket: each member is compared with the
bucket's most connected member, at three resolutions (1, 2 and 4 neighbouring
bands), so that a group of n copies makes about n candidates. Candidates are
verified by the exact Jaccard of their shingle sets. Where the members of a
bucket other than its leader then still belong to several components, all pairs
of them across components are verified too, by pairs of blocks of ``BLOCK``
members, each pair of texts in one of its buckets only. So any two texts that
share a band are in one class, or have been compared.

Defined results: words are runs without ASCII white space, A-Z as a-z; a text
of fewer than ``k`` words is one shingle; null text counts as empty; a text
without words is linked to equal texts only; a class is named by its smallest
doc id (null ids come last); repeated rows share their class; an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from settlekit.llm.common import shipped, written
from settlekit.llm.components import components
from settlekit.llm.textvec import U, Words, batches, mix, shingles_of

REGISTERS, ROWS, SHINGLE, THRESHOLD = 64, 4, 5, 0.8
#: members and characters of a block, about
BLOCK, BLOCK_CHARS = 128, 1 << 22
#: characters of texts signed at once (about 200 bytes of arrays each)
TOGETHER = 1 << 19


def weighted(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (hash, text number, weight)."""
    runs, owner = shingles_of(w, k)
    if not len(runs):
        return runs, owner, np.empty(0)
    key = mix(runs ^ (owner.astype(U) * U(0x9E3779B97F4A7C15)))  # a shingle within its text
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return runs[first], owner[first], 1.0 + np.log(count)


def signatures(element: np.ndarray, owner: np.ndarray, weight: np.ndarray, texts: int, m: int) -> np.ndarray:
    """ProbMinHash registers of all texts of a batch: texts x m shingle hashes."""
    time = np.full(texts * m, np.inf)
    kept = np.zeros(texts * m, U)
    clock, i = np.zeros(len(element)), 0
    while len(element):
        draw = mix(element + U((2 * i + 1) * 0xD1342543DE82EF95 % (1 << 64)))
        clock = clock - np.log((((draw >> U(11)).astype(np.float64)) + 0.5) / 9007199254740992.0) / weight
        slot = owner * m + (mix(draw) % U(m)).astype(np.int64)
        np.minimum.at(time, slot, clock)
        won = time[slot] == clock
        kept[slot[won]] = element[won]
        alive = clock < time.reshape(texts, m).max(axis=1)[owner]
        element, owner, weight, clock, i = element[alive], owner[alive], weight[alive], clock[alive], i + 1
    return kept.reshape(texts, m)


def _band_hashes(sig: np.ndarray, rows: int) -> list[list[int]]:
    sig = sig.reshape(len(sig), -1, rows)
    hashes = np.tile(np.arange(1, sig.shape[1] + 1, dtype=U), (len(sig), 1))
    for r in range(rows):
        hashes = mix(hashes * U(0x9E3779B97F4A7C15) + sig[:, :, r])
    return hashes.view(np.int64).tolist()


def _bands(k: int, m: int, rows: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f["__text"].tolist()
            out = []
            for a, b in batches(texts, TOGETHER):
                w = Words(texts[a:b])
                element, owner, weight = weighted(w, k)
                by_weight = _band_hashes(signatures(element, owner, weight, b - a, m), rows)
                uneven = np.isin(owner, np.unique(owner[weight > 1]))  # the others' bands are the same
                by_set = _band_hashes(signatures(element[uneven], owner[uneven], np.ones(int(uneven.sum())), b - a, m), rows)
                again = set(owner[uneven].tolist())
                out += [None if not n else h + [x for x in g if x not in h] if i in again else h
                        for i, (h, g, n) in enumerate(zip(by_weight, by_set, w.n))]
            yield pd.DataFrame({"id": f["id"].astype("object"), "node": f["node"], "bands": pd.Series(out, index=f.index, dtype=object)})
    return run


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two sorted arrays of distinct hashes."""
    if not len(a) and not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _verify(k: int, threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple[str, np.ndarray] = ("", np.empty(0, U))  # rows of one b come together
        for f in frames:
            keep = []
            for b_node, ta, tb in zip(f["b"], f["ta"], f["tb"]):
                if last[0] != b_node:
                    last = (b_node, np.unique(shingles_of(Words([tb]), k)[0]))
                keep.append(jaccard(np.unique(shingles_of(Words([ta]), k)[0]), last[1]) >= threshold)
            yield f.loc[keep, ["a", "b"]]
    return run


def _pairs(members: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b): every member of a bucket with the bucket's leader."""
    lead = members.groupBy(*keys).agg(F.max(F.struct("rank", "node")).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return (members.join(lead, keys).where(F.col("node") != F.col("m.node"))
            .select(F.least("node", "m.node").alias("a"), F.greatest("node", "m.node").alias("b")).distinct())


def similar(texts: list[str], k: int, threshold: float) -> np.ndarray:
    """Which texts have a Jaccard of ``threshold`` or more, as a matrix."""
    sets = [np.unique(shingles_of(Words([t]), k)[0]) for t in texts]
    size = np.array([len(x) for x in sets])
    value, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = (np.cumsum(n > 1) - 1)[at]  # shingles of one text only are in no intersection
    owner = np.repeat(np.arange(len(texts)), size)
    owner, column = owner[n[at] > 1], column[n[at] > 1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both, width = np.zeros((len(texts), len(texts)), np.int64), 1 << 14
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, (a, a + width))
        block = np.zeros((len(texts), width), np.float32)
        block[owner[i:j], column[i:j] - a] = 1
        both += (block @ block.T).astype(np.int64)  # whole numbers up to 2^14: exact
    np.fill_diagonal(both, size)
    every = size[:, None] + size[None, :] - both
    return both / np.maximum(every, 1) >= threshold


def _block_links(k: int, threshold: float):
    """Links across the components of a pair of blocks, as far as they join them."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("node", ignore_index=True)
        n, key = len(f), f["key"].iloc[0]
        # a pair is compared in the smallest of its common keys
        having: dict[int, list[int]] = {}
        for i, keys in enumerate(f["bands"]):
            for x in set(keys):
                if x < key:
                    having.setdefault(x, []).append(i)
        _, root = np.unique(f["root"].to_numpy(str), return_inverse=True)
        side = f["side"].to_numpy()
        todo = np.triu(root[:, None] != root[None, :])
        if (side == 1).any():
            todo &= side[:, None] != side[None, :]
        for rows in having.values():
            if len(rows) > 1:
                todo[np.ix_(rows, rows)] = False
        out: list[tuple[str, str]] = []
        if todo.any():
            node, parent = f["node"].tolist(), list(range(n))

            def find(i: int) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            used = np.flatnonzero(todo.any(axis=0) | todo.any(axis=1))
            hit = todo[np.ix_(used, used)] & similar([f["text"].iloc[i] for i in used], k, threshold)
            for i, j in zip(*(used[x] for x in np.nonzero(hit))):
                x, y = find(int(root[i])), find(int(root[j]))
                if x != y:
                    parent[x] = y
                    out.append((min(node[i], node[j]), max(node[i], node[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype=object)
    return run


def _across(shared: DataFrame, roots: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """(a, b): links between the components of each bucket's members. The leader
    has been compared with all of them and is left out. A component of more than
    a block has blocks of its own, which are not paired with each other; the
    smaller ones of a bucket share blocks."""
    members = (shared.join(roots, "node", "left").join(texts.select("node", "chars"), "node")
               .select("node", "rank", F.coalesce("root", "node").alias("root"), "chars", F.explode(F.array_distinct("bands")).alias("key")))
    lead = members.groupBy("key").agg(F.max(F.struct("rank", "node")).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 2")
    rest = members.join(lead, "key").where(F.col("node") != F.col("m.node")).select("key", "node", "root", "chars")
    pieces = F.ceil(F.greatest(F.sum("n") / BLOCK, F.sum("chars") / BLOCK_CHARS))
    sizes = rest.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    several = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("roots")).where("roots > 1").select("key")
    own = F.when((F.col("n") > BLOCK) | (F.col("chars") > BLOCK_CHARS), F.col("root")).otherwise("")
    sizes = written(sizes.join(several, "key").withColumn("own", own), "minhash-sizes")
    blocks = sizes.groupBy("key", "own").agg(F.greatest(pieces, F.lit(1)).cast("long").alias("pieces"))
    cells = blocks.select("key", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
    cell = F.struct("own", "piece")
    pairs = (cells.select("key", cell.alias("p")).join(cells.select("key", cell.alias("q")), "key")
             .where((F.col("p") < F.col("q")) & ((F.col("p.own") != F.col("q.own")) | (F.col("p.own") == ""))
                    | (F.col("p") == F.col("q")) & (F.col("p.own") == "")))
    pairs = written(pairs, "minhash-blocks")
    placed = (rest.join(sizes.select("key", "root", "own"), ["key", "root"]).join(blocks, ["key", "own"])
              .select("key", "node", "root", F.struct("own", F.pmod(F.xxhash64("node"), F.col("pieces")).alias("piece")).alias("c")))
    placed = written(placed, "minhash-placed")
    sent = (placed.withColumnRenamed("c", "p").join(pairs, ["key", "p"]).withColumn("side", F.lit(0))
            .unionByName(placed.withColumnRenamed("c", "q").join(pairs.where(F.col("p") != F.col("q")), ["key", "q"]).withColumn("side", F.lit(1))))
    full = sent.join(shared.select("node", "bands"), "node").join(texts.select("node", "text"), "node")
    return full.groupBy("key", "p", "q").applyInPandas(_block_links(k, threshold), "a string, b string").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE,
                    threshold: float = THRESHOLD, m: int = REGISTERS, rows: int = ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, class_id (smallest doc id of its class),
    class_size (rows), n_links (verified links of its text to different texts;
    texts of one class are not all compared, so at most its near-duplicates),
    kept (whether it is the class's first row by id, then text hash)."""
    shipped(docs.sparkSession)
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    given = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.md5(t).alias("node"), t.alias("__text"))
    signed = given.mapInPandas(_bands(k, m, rows), "id long, node string, bands array<long>")
    # rows of one text collapse to a node
    signed = written(signed.groupBy("id", "node").agg(F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies")), "minhash-signed")
    nodes = signed.groupBy("node").agg(F.first("bands").alias("bands"))

    band = nodes.where(F.col("bands").isNotNull()).select("node", F.explode("bands").alias("key"))
    sizes = band.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # how often a node's bands are shared: the middle of a group of copies comes first
    popular = band.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("rank"))
    shared = written(popular.join(nodes, "node"), "minhash-shared")

    n_bands = m // rows
    finer = [F.array(*[F.xxhash64(*[F.get("bands", (i + j) % n_bands) for j in range(width)], F.lit(width)) for i in range(n_bands)])
             for width in (2, 4)]
    members = shared.select("node", "rank", F.explode(F.concat("bands", *finer)).alias("key"))
    texts = written(given.join(shared.select("node"), "node", "left_semi").groupBy("node").agg(F.first("__text").alias("text")).withColumn("chars", F.char_length("text")), "minhash-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
                .join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb"))
        return written(both.mapInPandas(_verify(k, threshold), "a string, b string"), "minhash-links")

    links = [verified(written(_pairs(members, ["key"]), "minhash-pairs"))]
    roots = components(links[0], "minhash-components")
    found = written(_across(shared, roots, texts, k, threshold), "minhash-links")
    if not found.isEmpty():
        links.append(found)
        roots = components(reduce(DataFrame.unionByName, links), "minhash-components")

    every = reduce(DataFrame.unionByName, links).distinct()
    degree = (every.select(F.col("a").alias("node")).unionByName(every.select(F.col("b").alias("node")))
              .groupBy("node").agg(F.count(F.lit(1)).alias("n_links")))
    info = roots.join(degree, "node")
    placed = (signed.select("id", "node", "copies").join(info, "node", "left")
              .select("id", "node", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    first = F.min(F.struct(F.col("id").isNull().alias("z"), "id", "node"))
    classes = placed.groupBy("root").agg(first.alias("f"), F.sum("copies").alias("class_size"))
    out = placed.join(classes, "root")
    kept = F.col("f.id").eqNullSafe(F.col("id")) & (F.col("f.node") == F.col("node"))
    # repeated rows were one row until here: all come back, the first as the kept one
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        F.col("id").alias("doc_id"), F.col("f.id").alias("class_id"), "class_size", "n_links", (kept & (F.col("copy") == 1)).alias("kept"),
        "node")


def node_of(text: Column) -> Column:
    """The node a text belongs to, as returned in ``node``."""
    return F.md5(F.coalesce(text, F.lit("")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class (columns and text unchanged)."""
    kept = near_duplicates(docs, doc_id, text, **options).where("kept").select(F.col("doc_id").alias("__id"), F.col("node").alias("__node"))
    named = docs.withColumns({"__id": F.col(f"`{doc_id}`").cast("long"), "__node": node_of(F.col(f"`{text}`"))})
    on = named["__id"].eqNullSafe(kept["__id"]) & (named["__node"] == kept["__node"])
    return named.join(kept, on, "left_semi").dropDuplicates(["__id", "__node"]).drop("__id", "__node")
