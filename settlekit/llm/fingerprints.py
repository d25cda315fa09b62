"""Document fingerprints as invertible Bloom lookup sketches of paragraphs.

A text's paragraphs are its lines, cut further after words whose hash ends in
zeros, so that one long line is many paragraphs and an edit touches few. Each
paragraph (and how often it came before in the text) has a 64-bit digest. A
sketch has cells of (count, sum of digests, sum of check hashes); each digest
goes into three cells, one in each third. Subtracting two sketches cancels
what the texts share; peeling cells that hold one digest recovers what differs.
When peeling fails, both texts are sketched again with four times the cells,
until it works; the sketch returned is always the first, small size.

Likeness of two texts: 1 - (digests that differ) / (digests of both together,
shared ones once), in 0..1; two texts without paragraphs are alike (1).

The edited text of a document is the text with its last floor(n / 2) code
points replaced by the first as many of the next document (ascending id; the
last is followed by the first).

Defined results: null text counts as empty; null ids come first; equal ids are
ordered by a hash of the text; a single document is its own next; equal texts
have equal fingerprints; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlekit.llm.common import shipped
from settlekit.llm.textvec import U, Words, mix, span_hashes

CELLS = 24
#: characters of texts compared at once
TOGETHER = 1 << 20
_SALTS = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)]


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(digest, text number) of all paragraphs of a batch, by text."""
    w = Words(texts, fold=False)
    owner = w.text_of()
    if not len(owner):
        return np.empty(0, U), np.empty(0, np.int64)
    data = w.data
    breaks = np.concatenate(([0], np.cumsum(data == 10)))
    # a paragraph ends with a word that is followed by a line break, that cuts, or that is the text's last
    following = np.concatenate((w.start[1:], [len(data) - 1]))
    last = (breaks[following] > breaks[w.end]) | (w.hash & U(15) == 0)
    last[w.offset[1:][w.n > 0] - 1] = True
    end = np.flatnonzero(last)
    begin = np.concatenate(([0], end[:-1] + 1))
    digest = span_hashes(data, w.start[begin], w.end[end])
    of = owner[begin]
    # equal paragraphs of one text are told apart by how many came before
    key = mix(digest ^ mix(of.astype(U)))
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    nth = np.empty(len(order), np.int64)
    nth[order] = np.arange(len(order)) - first
    return mix(digest + nth.astype(U) * _SALTS[1]), of


def cells_of(digest: np.ndarray, cells: int) -> np.ndarray:
    """Three cells of each digest, one in each third of the sketch."""
    third = cells // 3
    return np.stack([(mix(digest ^ s) % U(third)).astype(np.int64) + i * third for i, s in enumerate(_SALTS)], axis=1)


def check_of(digest: np.ndarray) -> np.ndarray:
    return mix(digest ^ U(0xD6E8FEB86659FD93))


def sketch(digest: np.ndarray, owner: np.ndarray, texts: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, sum, check) arrays of texts x cells; sums are modulo 2^64."""
    at = (cells_of(digest, cells) + owner[:, None] * cells).ravel()
    count = np.bincount(at, minlength=texts * cells).astype(np.int64)
    total, check = np.zeros(texts * cells, U), np.zeros(texts * cells, U)
    np.add.at(total, at, np.repeat(digest, 3))
    np.add.at(check, at, np.repeat(check_of(digest), 3))
    return tuple(x.reshape(texts, cells) for x in (count, total, check))


def peel(count: np.ndarray, total: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests left in differences of sketches, many at once.

    Returns (row, digest, sign) of what was recovered and, for each row,
    whether the sketch was emptied. The inputs are used up.
    """
    rows, cells = count.shape
    out: list[tuple] = []
    active = np.arange(rows)
    while len(active):
        c, t, k = count[active], total[active], check[active]
        sign = np.where(np.abs(c) == 1, c, 0)
        value = np.where(sign < 0, np.zeros((), U) - t, t)
        pure = (sign != 0) & (np.where(sign < 0, np.zeros((), U) - k, k) == check_of(value))
        r, i = np.nonzero(pure)
        if not len(r):
            break
        found = pd.DataFrame({"r": active[r], "d": value[r, i], "s": sign[r, i]}).drop_duplicates()
        row, digest, s = found["r"].to_numpy(), found["d"].to_numpy(), found["s"].to_numpy()
        at = (cells_of(digest, cells) + row[:, None] * cells).ravel()
        minus = np.where(s < 0, digest, np.zeros((), U) - digest)
        minus_check = np.where(s < 0, check_of(digest), np.zeros((), U) - check_of(digest))
        np.add.at(count.reshape(-1), at, np.repeat(-s, 3))
        np.add.at(total.reshape(-1), at, np.repeat(minus, 3))
        np.add.at(check.reshape(-1), at, np.repeat(minus_check, 3))
        out.append((row, digest, s))
        active = np.unique(active[r])
    empty = ~(count.any(axis=1) | total.any(axis=1) | check.any(axis=1))
    if not out:
        return np.empty(0, np.int64), np.empty(0, U), np.empty(0, np.int64), empty
    return *(np.concatenate(x) for x in zip(*out)), empty


def differences(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], texts: int, cells: int = CELLS) -> np.ndarray:
    """How many digests differ between the i-th texts of two batches."""
    wanted, result = np.arange(texts), np.zeros(texts, np.int64)
    (da, oa), (db, ob) = a, b
    size = np.bincount(oa, minlength=texts) + np.bincount(ob, minlength=texts)
    while len(wanted):
        step = max(1, (1 << 20) // cells)  # rows of sketches held at a time
        failed = []
        for low in range(0, len(wanted), step):
            some = wanted[low:low + step]
            number = np.full(texts, -1)
            number[some] = np.arange(len(some))
            sketches = [sketch(d[number[o] >= 0], number[o][number[o] >= 0], len(some), cells) for d, o in ((da, oa), (db, ob))]
            row, _, sign, empty = peel(*(x - y for x, y in zip(*sketches)))
            n = np.bincount(row, minlength=len(some))
            # signs must fit the sizes: a wrong peel that ends empty would not
            net = np.bincount(row, sign, len(some)).astype(np.int64)
            right = empty & (net == (np.bincount(oa, minlength=texts) - np.bincount(ob, minlength=texts))[some]) & (n <= size[some])
            result[some[right]] = n[right]
            failed.append(some[~right])
        wanted, cells = np.concatenate(failed), cells * 4
    return result


def fingerprint_text(count: np.ndarray, total: np.ndarray, check: np.ndarray) -> list[str]:
    """Each sketch as text: the counts (2 bytes), sums (8) and checks (4) of its cells."""
    width = count.shape[1]
    raw = np.empty((len(count), width * 14), np.uint8)
    raw[:, :width * 2] = np.ascontiguousarray((count & 0xFFFF).astype("<u2")).view(np.uint8)
    raw[:, width * 2:width * 10] = np.ascontiguousarray(total.astype("<u8")).view(np.uint8)
    raw[:, width * 10:] = np.ascontiguousarray((check & U(0xFFFFFFFF)).astype("<u4")).view(np.uint8)
    return [base64.b64encode(r.tobytes()).decode() for r in raw]


def _likeness(a: tuple, b: tuple, texts: int, cells: int) -> np.ndarray:
    na, nb = np.bincount(a[1], minlength=texts), np.bincount(b[1], minlength=texts)
    d = differences(a, b, texts, cells)
    union = (na + nb + d) // 2
    return np.where(union > 0, 1 - d / np.maximum(union, 1), 1.0)


def edited(text: str, following: str) -> str:
    n = len(text) // 2
    return text[:len(text) - n] + following[:n]


def _compare(rows: list[tuple], cells: int) -> pd.DataFrame:
    """rows: (doc_id, text, next text)."""
    texts = [t for _, t, _ in rows]
    others = [edited(t, n) for _, t, n in rows]
    n = len(rows)
    own, changed, after = digests(texts), digests(others), digests([x for _, _, x in rows])
    return pd.DataFrame({
        "doc_id": pd.array([i for i, _, _ in rows], "Int64"), "n_chars": list(map(len, texts)),
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in others],
        "fingerprint": fingerprint_text(*sketch(*own, n, cells)), "edited_fingerprint": fingerprint_text(*sketch(*changed, n, cells)),
        "near_edited": _likeness(own, changed, n, cells), "near_next": _likeness(own, after, n, cells)})


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _in_order(cells: int):
    """Rows sorted by (bucket, order); each is compared with the next of its
    bucket, and the look-ahead row at a bucket's end is not returned itself."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pending, size, last = [], 0, None
        for f in frames:
            for r in f.itertuples(index=False):
                now = (r.bucket, None if pd.isna(r.id) else int(r.id), r.text, r.ahead)
                if last is not None and last[0] == now[0] and not last[3]:
                    pending.append((last[1], last[2], now[2]))
                    size += len(last[2])
                    if size > TOGETHER:
                        yield _compare(pending, cells)
                        pending, size = [], 0
                last = now
        if pending:
            yield _compare(pending, cells)
    return run


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None, cells: int = CELLS) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness.

    Documents are dealt into ranges of ids; each range also gets the first
    document of the next one, so the text moves once and no task sees more than
    its range. Range borders come from a sketch of the ids.
    """
    if cells % 3:
        raise ValueError("cells must be a multiple of 3")
    spark = shipped(docs.sparkSession)
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    given = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), t.alias("text")).withColumn("h", F.xxhash64("text"))
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / buckets for i in range(1, buckets)]
    ids = given.where(F.col("id").isNotNull()).select("id")
    borders = sorted(set(map(int, ids.approxQuantile("id", shares, 0.2 / buckets)))) if shares and not ids.isEmpty() else []
    # how many borders are at or below the id; null ids come first
    edges = F.array(*[F.lit(b).cast("long") for b in borders]) if borders else F.array().cast("array<long>")
    bucket = F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.size(F.filter(edges, lambda b: b <= F.col("id"))))
    placed = given.withColumn("bucket", bucket)
    firsts = sorted(placed.groupBy("bucket").agg(F.min(F.struct(F.col("id").isNotNull().alias("z"), "id", "h")).alias("m")).collect(), key=lambda r: r["bucket"])
    if not firsts:
        return spark.createDataFrame([], SCHEMA)
    # the first row of each range is also sent to the end of the range before; the very first to the last
    ahead = spark.createDataFrame([(firsts[i - 1]["bucket"], r["m"]["id"], r["m"]["h"], r["bucket"]) for i, r in enumerate(firsts)],
                                  "to long, fid long, fh long, bucket int")
    same = placed["id"].eqNullSafe(ahead["fid"]) & (placed["h"] == ahead["fh"]) & (placed["bucket"] == ahead["bucket"])
    sent = (placed.join(F.broadcast(ahead), same).groupBy("to").agg(F.first("text").alias("text"))
            .select(F.col("to").cast("int").alias("bucket"), F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("h"), "text", F.lit(True).alias("ahead")))
    dealt = placed.select("bucket", "id", "h", "text", F.lit(False).alias("ahead")).unionByName(sent)
    ordered = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "ahead", F.col("id").asc_nulls_first(), "h")
    return ordered.select("bucket", "id", "text", "ahead").mapInPandas(_in_order(cells), SCHEMA)
