"""Benchmark decontamination: BM25 search of test items for every passage.

Test items are cut into units of at most ``passage`` words. Every document is
cut into overlapping passages of 2 * ``passage`` words, one starting every
``passage`` words, so that every unit that is in a text lies within a passage.
A passage is a query of its distinct words; a unit is found when its BM25 score
reaches ``share`` of the score that the unit's own text gets.

Scores are divided by that threshold, so each unit is found at 1. As in WAND,
the terms with the smallest upper bounds, which together can't reach ``spare``,
are set aside: only the postings of the others are walked. They are summed by
block of units with the block's largest impact (block-max); only blocks that
can reach 1 - spare are opened, and only units in them whose sum reaches 1 - spare
are scored over all terms. Nothing that reaches 1 is lost.

A found unit is verified: at least ``overlap`` of the five-word runs of its
first half (question) and of its second half (answer) occur near the passage.
A given ``answer`` column makes units of question and answer texts instead.

The index of a block of items is broadcast; its size is bounded by
``block_items`` items and ``block_words`` words, and more items are searched
block by block. Item and term statistics cover all items.

Defined results: words are runs without ASCII white space, A-Z as a-z; null
text counts as empty and finds nothing; items without words are never found;
several items with one id give one row, the best; repeated documents give one
row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlekit.llm.common import shipped
from settlekit.llm.textvec import U, Words, batches, shingles

K1, B = 1.2, 0.75
CELLS = 1 << 21  # passages x units that are summed at a time
TOGETHER = 1 << 19  # characters of texts searched at once
SCHEMA = "doc_id long, node string, item_id long, score double, question_overlap double, answer_overlap double"


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    return np.unique(shingles(words, min(k, len(words)))) if len(words) else np.empty(0, U)


class Index:
    """Impact-ordered parts of a block of units, ready for searching."""

    def __init__(self, units: list[tuple[int, np.ndarray, int]], df: dict[int, int], n_units: int, mean_length: float,
                 share: float, spare: float, block: int, k: int):
        """units: (item id, word hashes, number of question words)."""
        self.items = [u[0] for u in units]
        self.parts = [(min(k, max(1, q)), min(k, max(1, len(w) - q)), _runs(w[:q], k), _runs(w[q:], k)) for _, w, q in units]
        self.block, self.n_blocks = block, -(-len(units) // block)
        rows, cols, impact = [], [], []
        for u, (_, words, _) in enumerate(units):
            terms, tf = np.unique(words, return_counts=True)
            f = np.array([df[int(t)] for t in terms], float)
            x = np.log1p((n_units - f + 0.5) / (f + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_length))
            rows.append(terms), cols.append(np.full(len(terms), u)), impact.append(x / (share * x.sum()))
        hashes, col, value = map(np.concatenate, (rows, cols, impact))
        self.vocabulary, term = np.unique(hashes, return_inverse=True)
        order = np.lexsort((col, term))
        self.term, self.unit, self.value = term[order], col[order], value[order]
        self.first = np.searchsorted(self.term, np.arange(len(self.vocabulary) + 1))
        bound = np.maximum.reduceat(self.value, self.first[:-1])
        small = np.argsort(bound)
        aside = small[np.cumsum(bound[small]) < spare]
        self.needed = 1.0 - bound[aside].sum() - 1e-9
        self.essential = np.ones(len(self.vocabulary), bool)
        self.essential[aside] = False
        # block postings: the largest impact of a term within each block of units
        key = self.term * self.n_blocks + self.unit // block
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        self.block_id, self.block_max = key[at] % self.n_blocks, np.maximum.reduceat(self.value, at)
        self.block_first = np.searchsorted(key[at] // self.n_blocks, np.arange(len(self.vocabulary) + 1))
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.vocabulary & U((1 << 20) - 1)).astype(np.int64)] = True

    def terms_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, term) of the words that are in the vocabulary."""
        place = np.flatnonzero(self.sieve[(words & U((1 << 20) - 1)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.vocabulary, words[place]), len(self.vocabulary) - 1)
        hit = self.vocabulary[term] == words[place]
        return place[hit], term[hit]

    def _postings(self, first: np.ndarray, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, place) of all postings of the given terms."""
        n = first[term + 1] - first[term]
        skip = np.repeat(first[term] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        return np.repeat(passage, n), skip + np.arange(len(skip))

    def search(self, passage: np.ndarray, term: np.ndarray) -> list[tuple[int, int, float]]:
        """All (passage, unit, score) with a score of 1 or more; given the
        distinct (passage, term) pairs in ascending order."""
        found, units = [], self.n_blocks * self.block
        step = max(1, CELLS // units)
        for low in range(0, int(passage[-1]) + 1 if len(passage) else 0, step):
            here = slice(*np.searchsorted(passage, (low, low + step)))
            q, t = passage[here] - low, term[here]
            on = self.essential[t]
            p, at = self._postings(self.block_first, q[on], t[on])
            bound = np.bincount(p * self.n_blocks + self.block_id[at], self.block_max[at], step * self.n_blocks)
            opened = bound >= self.needed
            some = opened.reshape(step, self.n_blocks).any(axis=1)[q] & on
            p, at = self._postings(self.first, q[some], t[some])
            u = self.unit[at]
            inside = opened[p * self.n_blocks + u // self.block]
            score = np.bincount(p[inside] * units + u[inside], self.value[at[inside]], step * units)
            for x in np.flatnonzero(score >= self.needed).tolist():
                p0, u0 = divmod(x, units)
                rest = t[np.searchsorted(q, p0):np.searchsorted(q, p0 + 1)]
                rest = rest[~self.essential[rest]]
                exact = score[x] + sum(self.value[a:b][self.unit[a:b] == u0].sum() for a, b in zip(self.first[rest], self.first[rest + 1]))
                if exact >= 1 - 1e-9:
                    found.append((low + p0, u0, float(exact)))
        return found


def _search(index, passage: int, k: int, overlap: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix: Index = index.value
        for f in frames:
            texts, out = f["text"].tolist(), []
            ids, nodes = f["doc_id"].astype("object").tolist(), f["node"].tolist()
            for a, b in batches(texts, TOGETHER):
                w = Words(texts[a:b])
                place, term = ix.terms_of(w.hash)
                owner = w.text_of()[place]
                # the stride blocks of a text are numbered on from those of the texts before it
                strides = -(-w.n // passage)
                base = np.concatenate(([0], np.cumsum(strides)))
                stride = base[owner] + (place - w.offset[owner]) // passage
                # a passage is a stride block and the next one of the same text
                before = stride > base[owner]
                v = len(ix.vocabulary)
                pairs = np.unique(np.concatenate((stride, stride[before] - 1)) * v + np.concatenate((term, term[before])))
                for q, unit, score in ix.search(pairs // v, pairs % v):
                    d = int(np.searchsorted(base, q, side="right")) - 1
                    start = w.offset[d] + (q - base[d]) * passage
                    near = w.hash[max(w.offset[d], start - passage):min(w.offset[d + 1], start + 3 * passage)]
                    kq, ka, question, answer = ix.parts[unit]
                    part = [np.isin(x, shingles(near, n)).mean() if len(x) else 1.0 for n, x in ((kq, question), (ka, answer))]
                    if min(part) >= overlap:
                        out.append((ids[a + d], nodes[a + d], ix.items[unit], score, *part))
            yield pd.DataFrame(out, columns=["doc_id", "node", "item_id", "score", "question_overlap", "answer_overlap"])
    return run


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
               question: str = "text", answer: str | None = None, passage: int = 64, share: float = 0.5, spare: float = 0.3,
               overlap: float = 0.5, k: int = 5, block: int = 16, block_items: int = 20_000, block_words: int = 2_000_000) -> DataFrame:
    """(doc_id, node, item_id, score, question_overlap, answer_overlap): test
    items found in documents, the best unit of each; ``node`` is the MD5 of
    the document's text."""
    spark = shipped(docs.sparkSession)
    col = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    given = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.md5(col(text)).alias("node"), col(text).alias("text"))
    asked = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), col(question).alias("q"), (col(answer) if answer else F.lit("")).alias("a"))

    def units_of(rows) -> list[tuple[int, np.ndarray, int]]:
        out = []
        for r in rows:
            w = Words([r["q"], r["a"]])
            words, nq = w.hash, int(w.n[0])
            for at in range(0, len(words), passage):
                # the last unit takes a short rest with it, overlapping the one before
                at = at if len(words) - at >= passage else max(0, len(words) - passage)
                unit = words[at:at + passage]
                out.append((r["item_id"], unit, min(max(nq - at, 0), len(unit)) if answer else len(unit) // 2))
        return out

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            units = [unit for _, unit, _ in units_of(f.to_dict("records"))]
            # a row for each term of a unit, and one without a term for the unit
            rows = [(t, len(unit)) for unit in units for t in [None, *np.unique(unit).view(np.int64).tolist()]]
            yield pd.DataFrame({"term": pd.array([t for t, _ in rows], "Int64"), "n": 1, "size": [n for _, n in rows]})

    stats = asked.mapInPandas(counted, "term long, n long, size long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    total = stats.where(F.col("term").isNull()).first()
    if total is None:
        return spark.createDataFrame([], SCHEMA)

    # blocks of items with bounded numbers of items and words
    sized = asked.withColumn("h", F.xxhash64("item_id", "q", "a"))
    words = F.sum(F.size(F.split(F.concat_ws(" ", "q", "a"), r"\s+"))).alias("w")
    whole = sized.agg(F.count(F.lit(1)).alias("n"), words).first()
    n_blocks = max(1, -(-whole["n"] // block_items), -(-whole["w"] // block_words))
    hits = []
    for i in range(n_blocks):
        rows = sized.where(F.pmod("h", F.lit(n_blocks)) == i).orderBy("item_id", "h").select("item_id", "q", "a").collect()
        units = units_of([r.asDict() for r in rows])
        if not units:
            continue
        needed = sorted({int(t) for _, u, _ in units for t in u.view(np.int64)})
        wanted = spark.createDataFrame([(t,) for t in needed], "term long")
        df = {r["term"] % (1 << 64): r["n"] for r in stats.join(wanted, "term", "left_semi").collect()}
        index = Index(units, df, total["n"], total["size"] / total["n"], share, spare, block, k)
        hits.append(given.mapInPandas(_search(spark.sparkContext.broadcast(index), passage, k, overlap), SCHEMA))
    found = reduce(DataFrame.unionByName, hits)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("m")
    return found.groupBy("doc_id", "node", "item_id").agg(best).select("doc_id", "node", "item_id", "m.*")


def drop_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text holds a test item."""
    bad = find_leaks(docs, items, doc_id, text, **options).select(F.col("doc_id").alias("__id"), F.col("node").alias("__node")).distinct()
    on = F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col("__id")) & (F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))) == F.col("__node"))
    return docs.join(bad, on, "left_anti")
