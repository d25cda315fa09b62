import hashlib
import random

import duckdb
import numpy as np

from settlekit.llm import fingerprints as fp
from settlekit.llm.queries import QUERIES
from tests.llm.conftest import DOCS


def brute(rows):
    """{position: (id, n_chars, sha of the edited text, edited text, next text)}"""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: r[0])
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        n = len(t) // 2
        e = t[:len(t) - n] + nxt[:n]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), t, e, nxt))
    return out


def exact(a, b):
    x, y = (set(fp.digests([t])[0].tolist()) for t in (a, b))
    return 1 - len(x ^ y) / len(x | y) if x | y else 1.0


def checked(out, rows):
    want = brute(rows)
    got = {r.doc_id: r for r in out}
    assert len(out) == len(want) == len(got)
    for i, n, sha, t, e, nxt in want:
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert abs(r.near_edited - exact(t, e)) < 1e-9 and abs(r.near_next - exact(t, nxt)) < 1e-9
    return got


def test_query_against_brute_force(spark, sf_dir):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    got = checked(QUERIES["op10_fingerprints"](spark, sf_dir).collect(), rows)
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t, set()).add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values()) and len({f for x in by_text.values() for f in x}) == len(by_text)
    long = [r for r in got.values() if r.n_chars > 500]
    assert sum(r.near_edited > r.near_next for r in long) > 0.9 * len(long)


def test_odd_rows_in_any_number_of_ranges(spark):
    rng = random.Random(1)
    line = lambda: " ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(rng.randrange(1, 20)))
    rows = [(i * 3, "\n".join(line() for _ in range(rng.randrange(0, 30)))) for i in range(60)]
    rows += [(1000, None), (1001, ""), (1002, "é🙂" * 3), (1003, "x\n" * 500), (1004, "w " * 30000), (1005, " \n\t")]
    for buckets in (1, 3, 50):
        checked(fp.with_next(spark.createDataFrame(rows, DOCS).repartition(5), buckets=buckets).collect(), rows)


def test_repeated_and_null_ids(spark):
    rows = [(None, "first"), (1, "a b"), (1, "a b"), (1, "c d"), (2, "z")]
    out = fp.with_next(spark.createDataFrame(rows, DOCS), buckets=2).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars) for r in out) == [(False, 0, 5), (True, 1, 3), (True, 1, 3), (True, 1, 3), (True, 2, 1)]
    assert next(r for r in out if r.doc_id == 2).edited_sha256 == hashlib.sha256(b"z").hexdigest()
    one = fp.with_next(spark.createDataFrame([(5, "alone here")], DOCS), buckets=4).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"alonealone").hexdigest()
    assert fp.with_next(spark.createDataFrame([], DOCS)).count() == 0


def test_peeling_recovers_the_differing_digests():
    rng = np.random.default_rng(4)
    shared = rng.integers(1, 1 << 62, 5000).astype(np.uint64)
    a, b = rng.integers(1, 1 << 62, 7).astype(np.uint64), rng.integers(1, 1 << 62, 4).astype(np.uint64)
    zero = lambda x: np.zeros(len(x), np.int64)
    x, y = np.concatenate((shared, a)), np.concatenate((b, shared))
    diff = [p - q for p, q in zip(fp.sketch(x, zero(x), 1, 48), fp.sketch(y, zero(y), 1, 48))]
    row, digest, sign, empty = fp.peel(*diff)
    assert empty.all() and set(digest[sign > 0].tolist()) == set(a.tolist()) and set(digest[sign < 0].tolist()) == set(b.tolist())
    # far too small a sketch: the retries find the count all the same
    assert fp.differences((x, zero(x)), (b, zero(b)), 1, 6).tolist() == [len(x) + len(b)]
