"""Repeated passages across documents, by sparse suffix arrays.

Of every text the suffixes that start at minimisers are kept: of each ``w``
neighbouring ``k``-word runs the one with the smallest hash (the first of
equals). The choice depends on the words only, and w + k - 1 <= ``length``, so
a passage of ``length`` words that two texts share has a kept suffix at the
same place in both. Suffixes whose run occurs in one text only go at once.
Suffixes that agree in their run and in the ``length - k`` words on both sides
of it have the same matches: they are one row from there on, with the first and
the last of their texts. These rows are sorted by run and following words, in
ranges over all executors, and neighbours are compared: how far they agree to
the right, and to the left of their start. A match of ``length`` words or more
marks both. The same is done in the order of the preceding words, which brings
those together that agree furthest to the left. A row's matches then go back to
all suffixes that it stands for. Kept suffixes follow each other closely, so the
marks of a long passage join to all of it.

Where a run is kept more than twice, a partner that agrees on both sides can
stand between others that agree on one side only. There every window of
``length`` words is also looked up by its hash: a window belongs to the kept
suffix of the smallest run in it, two texts that share a window choose the same
one, and a window that two texts hold marks both. Windows inside of later marks
are counted, but need no mark of their own.

Of equal texts one is searched; all of a repeated text of ``length`` words or
more is a passage. A mark is *later* in the document with the larger id: cutting
later marks leaves one copy of every passage.

Defined results: words are runs without ASCII white space, A-Z as a-z; null
text counts as empty; passages that repeat within one document only do not
count; null ids come first; repeated rows are copies of each other; an empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlekit.llm.common import row_key, shipped, work_dir, written
from settlekit.llm.textvec import U, Words, batches, mix, shingles
from settlekit.sinks import remove

LENGTH, RUN = 50, 10
HOT_RUNS, HOT_ROWS = 1000, 200


def minimisers(words: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the kept suffixes of one text."""
    runs = shingles(words, k)
    if len(runs) < w:
        return np.empty(0, np.int64), runs[:0]
    places = []
    for a in range(0, len(runs) - w + 1, 1 << 16):
        block = runs[a:a + (1 << 16) + w - 1]
        least = np.lib.stride_tricks.sliding_window_view(block, w).argmin(axis=1)
        places.append(np.unique(least + np.arange(len(least))) + a)
    at = np.unique(np.concatenate(places))
    return at, runs[at]


def _reach(length: int, k: int) -> int:
    """How many words beyond its run a kept suffix is compared over, each way:
    a passage of ``length`` words lies within them."""
    return max(1, length - k)


def _padded(words: np.ndarray, reach: int) -> np.ndarray:
    """The words of a text with 0 beyond its ends."""
    return np.concatenate((np.zeros(reach, words.dtype), np.maximum(words, 1), np.zeros(reach, words.dtype)))


def surroundings(words: np.ndarray, at: np.ndarray, k: int, reach: int) -> np.ndarray:
    """One hash of the words on both sides of each kept run."""
    padded = _padded(words, reach)
    steps = np.concatenate((np.arange(reach), np.arange(reach) + reach + k))
    weights = mix(np.arange(1, 2 * reach + 1, dtype=U)) | U(1)
    blocks = [mix((padded[at[a:a + 4096, None] + steps] * weights).sum(axis=1, dtype=U)) for a in range(0, len(at), 4096)]
    return np.concatenate(blocks) if blocks else np.empty(0, U)


def _kept(k: int, w: int, reach: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts, r1, r2 = f["text"].tolist(), f["r1"].to_numpy(), f["r2"].to_numpy()
            for a, b in batches(texts):
                words = Words(texts[a:b])
                found = [minimisers(words.hash[words.offset[i]:words.offset[i + 1]], k, w) for i in range(b - a)]
                n = [len(p) for p, _ in found]
                sides = [surroundings(words.hash[words.offset[i]:words.offset[i + 1]], p, k, reach) for i, (p, _) in enumerate(found)]
                yield pd.DataFrame({"run": np.concatenate([h for _, h in found]).view(np.int64), "sides": np.concatenate(sides).view(np.int64), "r1": np.repeat(r1[a:b], n),
                                    "r2": np.repeat(r2[a:b], n), "place": np.concatenate([p for p, _ in found])})
    return run


def _gathered(parts: Iterator[tuple], names: list[str], limit: int) -> Iterator[pd.DataFrame]:
    """Frames of about ``limit`` values from the columns of many texts, each given
    as (number of values, column, ...): a frame for each text costs more than its rows."""
    held, size = [], 0
    for n, *columns in parts:
        held.append(columns)
        size += n
        if size >= limit:
            yield pd.DataFrame(dict(zip(names, map(_joined, zip(*held)))))
            held, size = [], 0
    if held:
        yield pd.DataFrame(dict(zip(names, map(_joined, zip(*held)))))


def _joined(columns: tuple) -> np.ndarray | list:
    return [x for c in columns for x in c] if isinstance(columns[0], list) else np.concatenate(columns)


def _contexts(k: int, reach: int):
    """The words around runs, as 32-bit hashes: ``after`` from the run's end on,
    ``before`` backwards from its start; 0 beyond the text's ends."""
    steps = np.arange(reach)

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for f in frames:
            for text, places, runs, sides, least, most in zip(*(f[c] for c in ("text", "places", "runs", "sides", "least", "most"))):
                padded = _padded((Words([text]).hash >> np.uint64(32)).astype(np.uint32), reach)
                for a in range(0, len(places), 2048):
                    at = np.asarray(places[a:a + 2048], np.int64) + reach
                    # big-endian bytes sort like the words they stand for
                    around = [np.ascontiguousarray(padded[x].astype(">u4")).view(f"V{4 * reach}").ravel().tolist()
                              for x in (at[:, None] + k + steps, at[:, None] - 1 - steps)]
                    yield len(at), runs[a:a + 2048], sides[a:a + 2048], np.full(len(at), least), most[a:a + 2048], *around

    return lambda frames: _gathered(parts(frames), ["run", "sides", "least", "most", "after", "before"], 4096)


def _windows(length: int, k: int):
    """The windows of a text whose smallest kept run is kept more than twice, as
    lists of hashes and first words."""
    w = length - k + 1

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for f in frames:
            for r in f.itertuples(index=False):
                words = Words([r.text]).hash
                hashes = shingles(words, length)
                if not len(hashes):
                    continue
                at, n = np.asarray(r.places, np.int64), len(words) - k + 1
                least, often = np.full(n, np.iinfo(U).max, U), np.zeros(n, bool)
                least[at], often[at] = np.asarray(r.runs, np.int64).view(U), np.asarray(r.often, bool)
                for a in range(0, len(hashes), 1 << 16):
                    block = least[a:a + (1 << 16) + w - 1]
                    chosen = np.lib.stride_tricks.sliding_window_view(block, w).argmin(axis=1) + np.arange(a, a + len(block) - w + 1)
                    first = np.flatnonzero(often[chosen]) + a
                    if len(first):
                        yield len(first), [r.r1], [r.r2], [r.ord], [hashes[first].view(np.int64)], [first]

    return lambda frames: _gathered(parts(frames), ["r1", "r2", "ord", "keys", "firsts"], 1 << 16)


def _unsettled(length: int):
    """The windows that do not lie inside of the text's later marks."""
    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for f in frames:
            for r in f.itertuples(index=False):
                keys, first = np.asarray(r.keys, np.int64), np.asarray(r.firsts, np.int64)
                marks = np.zeros(0, np.int64) if r.marks is None else np.asarray(r.marks, np.int64)
                marks = marks[(marks & 1) == 1]
                spans = merged(list(zip((marks >> 32).tolist(), ((marks & 0xFFFFFFFF) >> 1).tolist())))
                if spans:
                    begin, end = np.array(spans, np.int64).T
                    i = np.searchsorted(begin, first, side="right") - 1
                    left = (i < 0) | (end[i] < first + length)
                    keys, first = keys[left], first[left]
                if n := len(first):
                    yield n, np.full(n, r.r1), np.full(n, r.r2), np.full(n, r.ord), keys, first

    return lambda frames: _gathered(parts(frames), ["r1", "r2", "ord", "key", "first"], 1 << 15)


_ROW = "run long, sides long, least long, most long, after binary, before binary"
_MATCH = "run long, sides long, left int, right int, first long, last long"


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading words agree, row by row; 0 marks the end of a text."""
    same = (a == b) & (a != 0)
    return np.where(same.all(axis=1), a.shape[1], same.argmin(axis=1))


def _matches(f: pd.DataFrame, i: np.ndarray, j: np.ndarray, length: int, k: int) -> pd.DataFrame:
    """Matches of the compared rows i and j, for both sides: how far they reach
    and the first and last text on the other side."""
    run, sides, least, most = (f[c].to_numpy(np.int64) for c in ("run", "sides", "least", "most"))
    use = (run[i] == run[j]) & ((least[i] != most[i]) | (least[j] != most[j]) | (least[i] != least[j]))
    i, j = i[use], j[use]
    after, before = (np.frombuffer(b"".join(f[c]), ">u4").reshape(len(f), -1) for c in ("after", "before"))
    right, left = k + agreement(after[i], after[j]), agreement(before[i], before[j])
    long = right + left >= length
    i, j, right, left = i[long], j[long], right[long], left[long]
    return pd.concat([pd.DataFrame({"run": run[x], "sides": sides[x], "left": left, "right": right, "first": least[y], "last": most[y]})
                      for x, y in ((i, j), (j, i))]).drop_duplicates()


def _leaders(f: pd.DataFrame) -> np.ndarray:
    """For each row the row of the smallest text so far with the same run."""
    n = len(f)
    by_text = np.lexsort((np.arange(n), f["least"].to_numpy(np.int64)))
    rank = np.empty(n, np.int64)
    rank[by_text] = np.arange(n)
    run = f["run"].to_numpy(np.int64)
    stretch = np.cumsum(np.concatenate(([False], run[1:] != run[:-1]))) * n
    return by_text[np.minimum.accumulate(rank - stretch) + stretch]


def _others(f: pd.DataFrame) -> np.ndarray:
    """For each row the last one before it that is not of the same text alone."""
    row = np.arange(len(f))
    least = f["least"].to_numpy(np.int64)
    alone = np.where(least == f["most"].to_numpy(np.int64), least, -1 - row)
    change = np.concatenate(([False], alone[1:] != alone[:-1]))
    return np.maximum.accumulate(np.where(change, row, 0)) - 1


def _neighbours(f: pd.DataFrame, length: int, k: int) -> pd.DataFrame:
    """Matches of each row with itself (where it stands for several texts), with
    the last one before it of another text, and with the smallest texts before
    and after it: these two let later marks reach all rows but one, however the
    texts are mixed."""
    n = len(f)
    row = np.arange(n)
    back = n - 1 - _leaders(f[::-1])[::-1]
    i, j = np.concatenate((row, row, row, row)), np.concatenate((row, _others(f), _leaders(f), back))
    some = j >= 0
    pairs = np.unique(np.stack((i[some], j[some]), axis=1), axis=0)
    return _matches(f, pairs[:, 0], pairs[:, 1], length, k)


def _sorted_matches(length: int, k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail, first = None, True
        for f in frames:
            if not len(f):
                continue
            if first:  # a range's first and last rows are compared with those of its neighbours later
                yield f.head(1).assign(kind=1)
                first = False
            f = f if tail is None else pd.concat([tail, f], ignore_index=True)
            yield _neighbours(f, length, k).assign(kind=0)
            tail = _tail(f)
        if tail is not None:
            yield tail.assign(kind=2)
    return run


def _tail(f: pd.DataFrame) -> pd.DataFrame:
    """The last row, the last one of another text, and the smallest text of its run."""
    return f.iloc[sorted({max(int(_others(f)[-1]), 0), int(_leaders(f)[-1]), len(f) - 1})].reset_index(drop=True)


def _neighbour_matches(rows: DataFrame, by: list[str], length: int, k: int, folder: str) -> DataFrame:
    """Matches from comparing neighbours in one order over all rows."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *by).sortWithinPartitions(*by)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["run", "sides", "least", "most", "after", "before", "left", "right", "first", "last", "kind"]
        for f in _sorted_matches(length, k)(frames):
            yield f.reindex(columns=names).astype(dict.fromkeys(("least", "most", "left", "right", "first", "last"), "Int64"))

    out = written(ranged.mapInPandas(run, f"{_ROW}, left int, right int, first long, last long, kind int"), f"by-{by[1]}", folder)
    # four rows at most of each range meet in one small frame
    edges = out.where("kind > 0").select("run", "sides", "least", "most", "after", "before")

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        if parts:
            yield _neighbours(pd.concat(parts).drop_duplicates().sort_values(by, ignore_index=True), length, k)

    joined = edges.repartition(1).mapInPandas(meet, _MATCH)
    return out.where("kind = 0").select("run", "sides", "left", "right", "first", "last").unionByName(joined)


def _marks(suffixes: DataFrame, groups: DataFrame, matches: DataFrame, folder: str) -> DataFrame:
    """For each text its marks, from the matches of the rows that stand for its
    suffixes. All matches of a suffix hold its run, so those that count (later
    ones apart) make one mark together."""
    # at most one entry for each pair of reaches, however many rows one was compared with
    found = (matches.groupBy("run", "sides", "left", "right").agg(F.min("first").alias("first"), F.max("last").alias("last"))
             .groupBy("run", "sides").agg(F.collect_list(F.struct("left", "right", "first", "last")).alias("found")))
    found = written(found, "matches", folder)
    # rows that stand for a share of 1 / HOT_ROWS or more of the suffixes (HOT_ROWS at most) are looked up where the suffixes are
    share = (groups.agg(F.sum("n")).first()[0] or 0) / HOT_ROWS
    key = ["run", "sides"]
    top = F.broadcast(groups.where(F.col("n") >= share).select(*key))
    both = suffixes.join(F.broadcast(found.join(top, key)), key).unionByName(
        suffixes.join(top, key, "left_anti").join(found.join(top, key, "left_anti"), key))
    others = F.filter("found", lambda x: (x["first"] != F.col("ord")) | (x["last"] != F.col("ord")))
    both = both.withColumn("others", others).where(F.size("others") > 0)
    both = both.withColumn("before", F.filter("others", lambda x: x["first"] < F.col("ord")))

    def mark(c: str, later: bool):
        return F.when(F.size(c) > 0, packed(F.col("place") - F.array_max(F.col(c)["left"]), F.col("place") + F.array_max(F.col(c)["right"]), F.lit(later)))

    return both.select("r1", "r2", F.explode(F.array_compact(F.array(mark("others", False), mark("before", True)))).alias("mark")).groupBy("r1", "r2").agg(
        F.collect_set("mark").alias("marks"))


def packed(first, last, later):
    """A mark as one number (32 bits first, 31 last, 1 later): many of them stay small in a task."""
    return F.shiftleft(first.cast("long"), 32).bitwiseOR(F.shiftleft(last.cast("long"), 1)).bitwiseOR(later.cast("long"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(text: str, places: np.ndarray, words: Words, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:places[words.start[a]]])
        at = places[words.end[b - 1]]
    return "".join(out) + text[at:]


def _digest(length: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                text = r.text
                w = Words([text], hashed=False)
                places = np.concatenate(([0], np.cumsum((w.data & 0xC0) != 0x80)))  # code points before each byte
                marks = np.zeros(0, np.int64) if r.marks is None else np.asarray(r.marks, np.int64)
                ends = lambda m: list(zip((m >> 32).tolist(), ((m & 0xFFFFFFFF) >> 1).tolist()))
                whole = [(0, len(w.start))] if r.copies > 1 and len(w.start) >= length else []
                spans, later = merged(ends(marks) + whole), merged(ends(marks[(marks & 1) == 1]))
                shown = [(int(places[w.start[a]]), int(places[w.end[b - 1]])) for a, b in spans]
                own, copy = _cut(text, places, w, later), _cut(text, places, w, merged(later + whole))
                out.append((r.r1, r.r2, shown, sum(b - a for a, b in spans), own, copy))
            yield pd.DataFrame(out, columns=["r1", "r2", "spans", "words", "own", "copy"])
    return run


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = RUN) -> DataFrame:
    """Per row: doc_id, spans (array of start, end in code points) of passages
    shared with other documents, repeated_words, text (later passages cut)."""
    w = length - k + 1
    if k < 1 or w < 1:
        raise ValueError("a run must not be longer than a passage")
    spark = shipped(docs.sparkSession)
    folder = work_dir(spark, "suffix")  # tables go as soon as nothing reads them any more

    def done(*names: str) -> None:
        for name in names:
            remove(spark, f"{folder}/{name}")

    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    given = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), t.alias("text")).withColumns(dict(zip(("r1", "r2"), row_key(F.col("text")))))
    nodes = given.groupBy("r1", "r2").agg(F.min(F.struct(F.col("id").isNotNull().alias("z"), "id")).alias("m"), F.count(F.lit(1)).alias("copies")).select("r1", "r2", F.col("m.id").alias("id"), "copies")
    # ord: the order of the texts by id, of equal ids by hash
    nodes = nodes.repartitionByRange("id", "r1", "r2").sortWithinPartitions("id", "r1", "r2").withColumn("ord", F.monotonically_increasing_id())
    nodes = written(nodes, "nodes", folder)

    reach = _reach(length, k)
    kept = written(given.select("text", "r1", "r2").mapInPandas(_kept(k, w, reach), "run long, sides long, r1 long, r2 long, place long"), "kept", folder)
    shared = written(kept.groupBy("run").agg(F.min("r1").alias("a"), F.max("r1").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("run", "n"), "runs", folder)
    # very frequent runs are looked up where the rows are: with a share of 1 / HOT_RUNS
    # or more of all rows there are HOT_RUNS of them at most
    share = (shared.agg(F.sum("n")).first()[0] or 0) / HOT_RUNS
    often = (F.col("n") > 2).alias("often")
    hot = F.broadcast(shared.where(F.col("n") >= share).select("run", often))
    cold = shared.where(F.col("n") < share).select("run", often)
    repeated = kept.join(hot, "run").unionByName(kept.join(hot, "run", "left_anti").join(cold, "run"))
    places = (repeated.distinct().groupBy("r1", "r2")
              .agg(F.collect_list(F.struct("place", "run", "sides", "often")).alias("x"))
              .select("r1", "r2", F.col("x.place").alias("places"), F.col("x.run").alias("runs"), F.col("x.sides").alias("sides"), F.col("x.often").alias("often")))
    wanted = written(nodes.join(places, ["r1", "r2"], "left").where("copies > 1 or places is not null"), "places", folder)
    done("kept", "runs")
    texts = given.join(wanted.select("r1", "r2"), ["r1", "r2"], "left_semi").groupBy("r1", "r2").agg(F.first("text").alias("text"))
    texts = written(texts, "texts", folder)

    each = F.explode(F.arrays_zip(F.col("places").alias("place"), F.col("runs").alias("run"), F.col("sides").alias("side")))
    suffixes = wanted.where("places is not null").select("r1", "r2", "ord", each.alias("s")).select("r1", "r2", "ord", "s.place", "s.run", F.col("s.side").alias("sides"))
    groups = written(suffixes.groupBy("run", "sides").agg(F.min("ord").alias("least"), F.max("ord").alias("most"), F.min_by("place", "ord").alias("place"),
                                                          F.count(F.lit(1)).alias("n")), "groups", folder)
    # the words of a row are taken from the first of its texts
    shown = (groups.groupBy(F.col("least").alias("ord")).agg(F.collect_list(F.struct("place", "run", "sides", "most")).alias("x"))
             .select("ord", F.col("x.place").alias("places"), F.col("x.run").alias("runs"), F.col("x.sides").alias("sides"), F.col("x.most").alias("most")))
    around = (wanted.select("r1", "r2", "ord").join(shown, "ord").join(texts, ["r1", "r2"])
              .select(F.col("ord").alias("least"), "text", "places", "runs", "sides", "most").mapInPandas(_contexts(k, reach), _ROW))
    around = written(around, "contexts", folder)
    matches = [_neighbour_matches(around, by, length, k, folder) for by in (["run", "after", "before"], ["run", "before", "after"])]
    done("contexts")
    by_text = written(_marks(suffixes, groups, matches[0].unionByName(matches[1]), folder), "marked", folder)
    done("by-after", "by-before", "matches", "groups")

    windows = (wanted.where(F.exists("often", lambda x: x)).join(texts, ["r1", "r2"]).select("r1", "r2", "ord", "text", "places", "runs", "often")
               .mapInPandas(_windows(length, k), "r1 long, r2 long, ord long, keys array<long>, firsts array<long>"))
    windows = written(windows, "windows", folder)
    held = (windows.select("ord", F.explode("keys").alias("key")).groupBy("key").agg(F.min("ord").alias("least"), F.max("ord").alias("most"))
            .where("least <> most").select("key", "least"))
    open_windows = windows.join(by_text, ["r1", "r2"], "left").select("r1", "r2", "ord", "keys", "firsts", "marks").mapInPandas(
        _unsettled(length), "r1 long, r2 long, ord long, key long, first long")
    more = (open_windows.join(held, "key").select("r1", "r2", "first", (F.col("first") + length).alias("last"), (F.col("ord") > F.col("least")).alias("later"))
            .groupBy("r1", "r2").agg(F.collect_set(packed(F.col("first"), F.col("last"), F.col("later"))).alias("marks")))
    by_text = by_text.unionByName(more).groupBy("r1", "r2").agg(F.flatten(F.collect_list("marks")).alias("marks"))
    info = wanted.select("r1", "r2", "copies").join(texts, ["r1", "r2"]).join(by_text, ["r1", "r2"], "left")
    found = written(info.where("copies > 1 or marks is not null").select("r1", "r2", "copies", "text", "marks").mapInPandas(
        _digest(length), "r1 long, r2 long, spans array<struct<start:long,end:long>>, words long, own string, copy string"), "found", folder)
    done("places", "texts", "marked", "windows")
    # of equal texts the smallest id keeps the text, and of equal rows one
    rows = given.join(nodes.select("r1", "r2", F.col("id").alias("least"), "copies").join(found, ["r1", "r2"], "left"), ["r1", "r2"])
    names = ["id", "text", "spans", "words", "own", "copy", "keeps"]
    alone = rows.where("copies = 1").withColumn("keeps", F.lit(True)).select(*names)
    many = (rows.where("copies > 1").groupBy("r1", "r2", "id", "least", "copies")
            .agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("text", "spans", "words", "own", "copy")])
            .withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
            .withColumn("keeps", F.col("id").eqNullSafe(F.col("least")) & (F.col("i") == 1)))
    out = alone.unionByName(many.select(*names))
    return out.select(F.col("id").alias("doc_id"), F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"),
                      F.coalesce("words", F.lit(0)).cast("long").alias("repeated_words"),
                      F.when(F.col("own").isNull(), F.col("text")).when(F.col("keeps"), F.col("own")).otherwise(F.col("copy")).alias("text"))

