"""Approximate nearest neighbours: one hierarchical navigable small-world graph
for each shard of the vectors, shard results merged.

Vectors are dealt to shards by hash, ``shard_floats`` components at most in the
mean, so a shard's size does not grow with the table. A shard's graph is stored
as flat arrays in one row: vectors, members and neighbours of each level with a
fixed width (-1: none), and the ids behind each node. A node is a *distinct* vector: copies
share it with their smallest ids, as many as a result can name. (Copies as nodes
of their own would be each other's only neighbours and cut the graph.)

Each level's graph is built from the level above: its members come first, the
rest is inserted in batches that double. A batch searches the graph so far from
the entry points the upper level gives, links by the usual diversity rule among
what it found and its own members, and adds the reverse links. Searching a shard
descends the levels and walks the lowest with a beam of ``ef``; all queries of a
batch take their steps together in numpy. Distances of what is found are
computed again from the original values in double precision.

Every query visits every shard, in tiles of ``tile`` queries by one shard: a
shard row moves once for each tile, a query once for each shard.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows without an id; equal rows count once, of
several vectors with one id the smallest does; a component over 1e15 times a
typical one counts as that while the graph is walked, not in a score; only vectors of the same
dimension are compared; equal distances go to the smaller id; an empty table,
or one vector alone, has no neighbours and gives no rows; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from settlekit.llm.common import shipped, written

#: Components of all vectors of a shard: 16,384 vectors of 64.
SHARD_FLOATS = 1 << 20
#: Links of a node above the lowest level; twice as many on the lowest.
LINKS = 16
EF_BUILD, EF_SEARCH = 64, 128
#: Queries of one search task, and of one numpy batch.
TILE, BATCH = 16_384, 512
#: Nodes expanded by a query in one step.
WAVE = 4

INDEX = ("shard int, dim int, vectors array<double>, levels array<int>, members array<int>, links array<int>, "
         "ids array<bigint>, id_starts array<int>")


# ---- one shard, in numpy -------------------------------------------------

def _distances(x: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of each query's own candidates (float32)."""
    d = x[at]
    d -= q[:, None, :]
    return np.einsum("bcd,bcd->bc", d, d)


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``ef`` nearest nodes that a beam finds for each query, nearest first:
    (nodes, squared distances), -1 and inf where fewer are reached. ``entry``
    holds start nodes by query (-1: none)."""
    n, b = len(x), len(q)
    rows = np.arange(b)
    stamp = np.full((b, n + 1), -1, np.int16)      # the last column takes the -1 links
    node = np.full((b, ef), -1, np.int64)
    dist = np.full((b, ef), np.inf, np.float32)
    done = np.ones((b, ef), bool)
    active = rows
    new = entry.astype(np.int64)
    while len(active):
        # of a node met twice in this step, the last place stays
        place = np.arange(new.shape[1], dtype=np.int16)
        fresh = (new >= 0) & (stamp[active[:, None], new] < 0)
        r, c = np.nonzero(fresh)
        stamp[active[r], new[r, c]] = place[c]
        fresh[r, c] = stamp[active[r], new[r, c]] == place[c]
        d = np.where(fresh, _distances(x, q[active], np.maximum(new, 0)), np.float32(np.inf))
        all_d = np.concatenate([dist[active], d], 1)
        all_n = np.concatenate([node[active], np.where(fresh, new, -1)], 1)
        all_f = np.concatenate([done[active], ~fresh], 1)
        order = np.argsort(all_d, 1, kind="stable")[:, :ef]
        dist[active] = np.take_along_axis(all_d, order, 1)
        node[active] = np.take_along_axis(all_n, order, 1)
        done[active] = np.take_along_axis(all_f, order, 1)
        # the nearest nodes of each beam that are not yet expanded
        open_ = ~done[active]
        left = open_.any(1)
        active, open_ = active[left], open_[left]
        if not len(active):
            break
        pick = np.argsort(~open_, 1, kind="stable")[:, :WAVE]
        chosen = np.take_along_axis(open_, pick, 1)
        from_ = np.where(chosen, node[active[:, None], pick], n)
        done[active[:, None], pick] = True
        padded = np.concatenate([links, np.full((1, links.shape[1]), -1, links.dtype)]) if links.shape[0] == n else links
        new = padded[from_].reshape(len(active), -1).astype(np.int64)
    return node, dist


def diverse(x: np.ndarray, at: np.ndarray, cand: np.ndarray, dist: np.ndarray, width: int) -> np.ndarray:
    """Links of each node ``at`` among its candidates, nearest first: those
    nearer to the node than to any link chosen before; then the nearest others
    fill up. ``cand`` is sorted by ``dist``; -1 has infinite distance."""
    b, c = cand.shape
    v = x[np.maximum(cand, 0)]
    sq = np.einsum("bcd,bcd->bc", v, v)
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    alive, taken = np.isfinite(dist), np.zeros((b, c), bool)
    count = np.zeros(b, np.int64)
    blocked = ~alive
    for j in range(c):
        take = ~blocked[:, j] & (count < width)
        taken[:, j] = take
        count += take
        blocked |= take[:, None] & (between[:, j, :] < dist)
    rank = np.where(taken, 0, np.where(alive, 1, 2))
    order = np.argsort(rank, 1, kind="stable")[:, :width]
    out = np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(cand, order, 1), -1)
    if out.shape[1] < width:
        out = np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)
    return out


def _link_back(x: np.ndarray, links: np.ndarray, new: np.ndarray) -> None:
    """Add the reverse of the new nodes' links; full lists are chosen anew."""
    width = links.shape[1]
    to, frm = links[new].ravel(), np.repeat(new, width)
    keep = to >= 0
    if not keep.any():
        return
    to, frm = to[keep].astype(np.int64), frm[keep]
    d = x[to] - x[frm]
    dist = np.einsum("nd,nd->n", d, d)
    order = np.lexsort((frm, dist, to))
    to, frm = to[order], frm[order]
    owners, start, count = np.unique(to, return_index=True, return_counts=True)
    slot = np.arange(len(to)) - np.repeat(start, count)
    most = int(min(count.max(), 2 * width))        # the nearest of very many
    ok = slot < most
    added = np.full((len(owners), most), -1, np.int64)
    added[np.repeat(np.arange(len(owners)), count)[ok], slot[ok]] = frm[ok]
    for s in range(0, len(owners), BATCH):
        own, more = owners[s:s + BATCH], added[s:s + BATCH]
        have = links[own].astype(np.int64)
        more = np.where((more[:, :, None] == have[:, None, :]).any(2), -1, more)
        cand = np.concatenate([have, more], 1)
        dd = np.where(cand >= 0, _distances(x, x[own], np.maximum(cand, 0)), np.float32(np.inf))
        by = np.argsort(dd, 1, kind="stable")
        cand, dd = np.take_along_axis(cand, by, 1), np.take_along_axis(dd, by, 1)
        links[own] = diverse(x, own, cand, dd, width)


def _among(x: np.ndarray, new: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of a batch its nearest others of the batch, by exact distance."""
    v = x[new]
    sq = np.einsum("nd,nd->n", v, v)
    nodes, dists = [], []
    for s in range(0, len(new), BATCH):
        d = np.maximum(sq[s:s + BATCH, None] + sq[None, :] - 2 * (v[s:s + BATCH] @ v.T), 0)
        d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
        k_ = min(k, d.shape[1])
        near = np.argpartition(d, k_ - 1, 1)[:, :k_]
        nodes.append(new[near])
        dists.append(np.take_along_axis(d, near, 1))
    return np.concatenate(nodes), np.concatenate(dists)


def _levels(n: int) -> np.ndarray:
    """Level of each node: one in LINKS of a level is also in the next. Nodes
    come in the order of a hash, so fixed places are as good as random ones and
    a shard that is built again gets the same graph."""
    out, step = np.zeros(n, np.int64), LINKS
    while step < n:
        out[::step] += 1
        step *= LINKS
    return out


class Graph:
    """Levels from the lowest up: ``members`` (nodes) and ``links`` over nodes'
    places in the level's member list."""

    def __init__(self, x: np.ndarray, members: list[np.ndarray], links: list[np.ndarray]):
        self.x, self.members, self.links = x, members, links

    @classmethod
    def built(cls, x: np.ndarray, ef: int = EF_BUILD) -> Graph:
        level = _levels(len(x))
        graph = cls(x, [], [])
        above: np.ndarray | None = None
        for lv in range(int(level.max()), -1, -1):
            here = np.nonzero(level >= lv)[0]
            # members of the level above come first
            order = here[np.argsort(-(level[here] > lv).astype(np.int64), kind="stable")]
            links = np.full((len(order), 2 * LINKS if lv == 0 else LINKS), -1, np.int32)
            graph.members.insert(0, order)
            graph.links.insert(0, links)
            graph._fill(len(above) if above is not None else min(len(order), BATCH), ef)
            above = order
        return graph

    def _fill(self, first: int, ef: int) -> None:
        members, links = self.members[0], self.links[0]
        x, width, done = self.x[members], links.shape[1], 0
        while done < len(members):
            new = np.arange(done, min(len(members), first if done == 0 else done + min(done, 2 * BATCH)))
            cand, dist = _among(x, new, ef)
            for s in range(0, len(new), BATCH):
                part = new[s:s + BATCH]
                c, d = cand[s:s + BATCH], dist[s:s + BATCH]
                if done:
                    found, fd = self._found(x[part], x[:done], links[:done], ef)
                    c, d = np.concatenate([c, found], 1), np.concatenate([d, fd], 1)
                by = np.argsort(d, 1, kind="stable")[:, :ef]
                links[part] = diverse(x, part, np.take_along_axis(c, by, 1), np.take_along_axis(d, by, 1), width)
            _link_back(x, links, new)
            done = new[-1] + 1

    def _found(self, q: np.ndarray, x: np.ndarray, links: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        return beam_search(x, links, q, self._entries(q, 1), ef)

    def _entries(self, q: np.ndarray, stop: int) -> np.ndarray:
        """Start places on level ``stop - 1``, found level by level from the top."""
        at = np.zeros((len(q), 1), np.int64)
        for lv in range(len(self.members) - 1, stop - 1, -1):
            x = self.x[self.members[lv]]
            # members of a level are the first of the next, so a place stays the same
            node, _ = beam_search(x, self.links[lv], q, at, 8)
            at = node[:, :4]
        return at

    def search(self, q: np.ndarray, k: int, ef: int = EF_SEARCH) -> np.ndarray:
        """Nodes near each query, the k nearest found (-1: fewer)."""
        out = []
        x = self.x[self.members[0]]
        for s in range(0, len(q), BATCH):
            part = q[s:s + BATCH]
            node, _ = beam_search(x, self.links[0], part, self._entries(part, 1), max(ef, k))
            out.append(np.where(node[:, :k] >= 0, self.members[0][node[:, :k]], -1))
        return np.concatenate(out) if out else np.zeros((0, k), np.int64)

    def flat(self) -> dict[str, np.ndarray]:
        """Levels as (size, width) pairs, members and links one after the other."""
        return {"levels": np.array([v for a in self.links for v in a.shape], np.int32),
                "members": np.concatenate(self.members).astype(np.int32), "links": np.concatenate([a.ravel() for a in self.links])}

    @classmethod
    def read(cls, x: np.ndarray, levels: np.ndarray, members: np.ndarray, links: np.ndarray) -> Graph:
        m, ls, a, b = [], [], 0, 0
        for size, width in np.asarray(levels).reshape(-1, 2):
            m.append(np.asarray(members[a:a + size], np.int64))
            ls.append(np.asarray(links[b:b + size * width], np.int32).reshape(size, width))
            a, b = a + size, b + size * width
        return cls(x, m, ls)


def _scale(v: np.ndarray) -> float:
    """Divisor for a shard's float32 copy: a typical vector's largest component,
    so that squares neither overflow nor vanish, one huge vector or not."""
    return float(np.median(np.abs(v).max(1)))


def _narrow(v: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(v / scale, -1e15, 1e15).astype(np.float32)


# ---- Spark ---------------------------------------------------------------

def clean_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, vec): one row for each id that takes part, components in double."""
    v = F.transform(F.col(f"`{embedding}`"), lambda x: x.cast("double") + F.lit(0.0))    # -0.0 becomes 0.0
    top = F.lit(float("inf"))
    fit = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < top)) & F.exists("vec", lambda x: x != 0)
    read = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("vec"))
    return read.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).where(fit).groupBy("vec_id").agg(F.min("vec").alias("vec"))


def _sharded(nodes: DataFrame, shard_floats: int) -> tuple[DataFrame, int]:
    """``nodes`` with ``shard``; dimensions between two powers of two share a
    run of shards, so the counts read here are 31 rows at most."""
    klass = F.floor(F.log2(F.size("vec").cast("double"))).cast("int")
    counts = {r["c"]: r["n"] for r in nodes.groupBy(klass.alias("c")).agg(F.sum(F.size("vec").cast("long")).alias("n")).collect()}
    shard, start = F.lit(0), 0
    for c, n in sorted(counts.items()):
        k = max(1, -(-n // shard_floats))
        shard = F.when(klass == c, F.lit(start) + F.pmod(F.xxhash64("vec"), F.lit(k))).otherwise(shard)
        start += k
    return nodes.withColumn("shard", shard.cast("int")), start


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for dim, same in rows.groupby("dim"):
        same = same.sort_values(["h", "first"], kind="stable")
        v = np.stack(same["vec"].to_numpy())
        ids = same["ids"].to_numpy()
        out.append({"shard": key[0], "dim": int(dim), "vectors": v.ravel(), **Graph.built(_narrow(v, _scale(v))).flat(),
                    "ids": np.concatenate(ids).astype(np.int64), "id_starts": np.cumsum([0] + [len(i) for i in ids]).astype(np.int32)})
    return pd.DataFrame(out)


def build_index(vectors: DataFrame, k: int = 10, shard_floats: int = SHARD_FLOATS) -> tuple[DataFrame, int]:
    """(index, shards): ``vectors`` as from ``clean_vectors``; results may name
    up to ``k`` vectors. One row for each shard and dimension."""
    shipped(vectors.sparkSession)
    # of copies, the k + 1 smallest ids can be named (one may be the query itself)
    small = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id")) <= k + 1
    nodes = (vectors.withColumn("_keep", small).where("_keep").groupBy("vec")
             .agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    nodes = written(nodes, "hnsw-nodes")
    placed, shards = _sharded(nodes, shard_floats)
    rows = placed.select("shard", F.size("vec").alias("dim"), F.xxhash64(F.lit(5), "vec").alias("h"), F.col("ids")[0].alias("first"), "vec", "ids")
    index = (rows.repartition(max(1, 2 * shards), "shard").groupBy("shard").applyInPandas(_build, INDEX) if shards
             else vectors.sparkSession.createDataFrame([], INDEX))
    return written(index, "hnsw-index"), shards


FOUND = "query_id long, vec_id long, score double"


def _search(k: int, ef: int):
    def run(key: tuple, queries: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in index.iterrows():
            dim = int(row["dim"])
            mine = queries[queries["dim"] == dim]
            if not len(mine):
                continue
            own, q = mine["query_id"].to_numpy(), np.stack(mine["vec"].to_numpy()).astype(np.float64)
            v = np.asarray(row["vectors"], np.float64).reshape(-1, dim)
            scale = _scale(v)
            near = Graph.read(_narrow(v, scale), row["levels"], row["members"], row["links"]).search(_narrow(q, scale), k + 1, ef)
            ids, starts = np.asarray(row["ids"], np.int64), np.asarray(row["id_starts"], np.int64)
            for s in range(0, len(q), BATCH):
                node = near[s:s + BATCH]
                d = v[np.maximum(node, 0)] - q[s:s + BATCH, None, :]
                score = np.sqrt((d * d).sum(2))
                r, c = np.nonzero(node >= 0)
                n = node[r, c]
                many = starts[n + 1] - starts[n]
                rep = np.repeat(np.arange(len(n)), many)
                at = np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many) + starts[n][rep]
                f = pd.DataFrame({"query_id": own[s:s + BATCH][r][rep], "vec_id": ids[at], "score": score[r, c][rep]})
                f = f[f["query_id"] != f["vec_id"]].sort_values(["query_id", "score", "vec_id"], kind="stable")
                out.append(f.groupby("query_id", sort=False).head(k))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    return run


def search(index: DataFrame, shards: int, queries: DataFrame, k: int = 10, ef: int = EF_SEARCH, tile: int = TILE) -> DataFrame:
    """The k nearest vectors that the index finds for each query (vec_id, vec),
    but the query's own: (query_id, rank, vec_id, score)."""
    spark = shipped(queries.sparkSession)
    if not shards:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = written(queries.select(F.col("vec_id").alias("query_id"), F.size("vec").alias("dim"), "vec"), "hnsw-queries")
    tiles = max(1, -(-queries.count() // tile))
    group = F.pmod(F.xxhash64("query_id"), F.lit(tiles)).cast("int").alias("tile")
    asked = queries.select(group, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "query_id", "dim", "vec")
    stored = index.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), *[F.col(c) for c in index.columns])
    n = max(1, 2 * shards * tiles)
    found = (asked.repartition(n, "tile", "shard").groupBy("tile", "shard")
             .cogroup(stored.repartition(n, "tile", "shard").groupBy("tile", "shard")).applyInPandas(_search(k, ef), FOUND))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def neighbours(vectors: DataFrame, every: int = 100, k: int = 10, shard_floats: int = SHARD_FLOATS, ef: int = EF_SEARCH) -> DataFrame:
    """Neighbours of the vectors whose id ``every`` divides, among all."""
    rows = written(clean_vectors(vectors), "hnsw-vectors")
    index, shards = build_index(rows, k, shard_floats)
    return search(index, shards, rows.where(F.col("vec_id") % every == 0), k, ef)
