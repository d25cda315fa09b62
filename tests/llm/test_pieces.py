import gc
import random
import weakref

import duckdb
import numpy as np
import pytest

from settlekit.llm import pieces as p
from tests.llm.conftest import DOCS


@pytest.fixture(scope="module")
def vocab():
    return p.Vocabulary.load(p.default_model()).prepare()


def toy():
    """Short pieces without word borders, so that states matter everywhere."""
    rng = random.Random(8)
    normal = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(40)} | {"a", "b", p.SPACE, "a" + p.SPACE + "b"})
    return p.Vocabulary([(t, -float(rng.randint(1, 9)), "normal") for t in normal] + [(f"<0x{i:02X}>", 0.0, "byte") for i in range(256)]).prepare()


def brute(v, x):
    """Best segmentation by trying every end for every position, plainly."""
    starts = [m.start() for m in v.word.finditer(x)]
    distance = [i - max(s for s in starts if s <= i) for i in range(len(x))]
    best = [None] * (len(x) + 1)
    best[0] = (0, b"")
    for j in range(1, len(x) + 1):
        for i in range(max(0, j - v.longest), j):
            s = x[i:j]
            if best[i] is None or (s not in v.weight and j - i > 1):
                continue
            ids = [v.ids[s]] if s in v.ids else [v.byte_ids[b] for b in (p.SPACE if s == p.OWN_SPACE else s).encode()]
            w = best[i][0] + v.weight.get(s, v.unknown) + p.BORDER[distance[i]]
            if best[j] is None or w > best[j][0]:
                best[j] = (w, best[i][1] + np.array(ids, np.int32).tobytes())
    return np.frombuffer(best[-1][1], np.int32).tolist()


TEXTS = [None, "", " ", "a", "▁", "x ▁▁ y", "Hello  world\n\n tabs\there", "naïve façade 漢字 🙂", "ab" * 60, "a b" * 40, "b" * 130 + " " + "a" * 7, "ab ba\nabab aab", "\n" * 30]


@pytest.mark.parametrize("chunk", [1, 2, 5, 13, 64, 4000])
def test_chunks_give_the_unchunked_result(spark, chunk):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(8, TEXTS[8])]
    for v in (toy(), p.Vocabulary.load(p.default_model()).prepare()):
        out = p.encode(spark.createDataFrame(rows, DOCS), vocabulary=v, chunk=chunk, fan_in=3)
        got = out.collect()
        want = {i: brute(v, p.SPACE + p.write_out(t)) if t else [] for i, t in rows}
        assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
        for r in got:
            assert r.ids == want[r.doc_id], (chunk, r.doc_id)
        if chunk == 5:
            back = {r.doc_id: r.decoded for r in p.decode(out, vocabulary=v).collect()}
            assert back == {i: t or "" for i, t in rows}


def test_product_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random((5, 5)) < 0.2, p.FAR, rng.integers(-99, 0, (5, 5))) for _ in range(3))
    assert (p.product(p.product(a, b), c) == p.product(a, p.product(b, c))).all()
    assert (p.product(a, b) == p.settled(np.array([[max(max(a[i, k] + b[k, j] for k in range(5)), p.FAR) for j in range(5)] for i in range(5)]))).all()


def unigram_model(path):
    """The same pieces and scores marked as a unigram model (trainer_spec.model_type = 1)."""
    raw = open(path, "rb").read()

    def varint(b, i):
        n = shift = 0
        while True:
            n |= (b[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if b[i - 1] < 128:
                return n, i

    def put(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out, i = b"", 0
    while i < len(raw):
        tag, j = varint(raw, i)
        size, k = varint(raw, j)
        body = raw[k:k + size]
        if tag >> 3 == 2:  # trainer_spec: the last value of a field counts
            body += put(3 << 3) + put(1)
        out += put(tag) + put(len(body)) + body
        i = k + size
    return out


def test_scores_at_least_those_of_the_library_as_unigram(vocab, sf_dir):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_proto=unigram_model(p.default_model()))
    # The library adds in 32-bit floats, so one prohibitive score (-1e9: a byte, a
    # lone space) hides small ones: words without those only.
    words = {w for t, in duckdb.sql(f"SELECT text FROM '{sf_dir}/documents.parquet' LIMIT 60").fetchall() for w in t.split()[:60]}
    plain = lambda ids: all(vocab.pieces[i][1] > -1e6 and vocab.pieces[i][2] == "normal" for i in ids)
    texts = [w for w in sorted(words) if plain(np.frombuffer(vocab.encode(p.SPACE + w), np.int32).tolist())]
    assert len(texts) > 500
    same = 0
    for t in texts:
        ours, theirs = np.frombuffer(vocab.encode(p.SPACE + p.write_out(t)), np.int32).tolist(), lib.encode(t)
        total = lambda ids: sum(vocab.pieces[i][1] for i in ids if vocab.pieces[i][2] == "normal")
        assert total(ours) >= total(theirs), t
        assert vocab.decode(ours) == t
        same += ours == theirs
    assert same > 0.8 * len(texts)


def test_query_round_trip(spark, sf_dir):
    from settlekit.llm.queries import QUERIES
    out = QUERIES["op2_sentencepiece"](spark, sf_dir).collect()
    assert len(out) == duckdb.sql(f"SELECT count(*) FROM '{sf_dir}/documents.parquet'").fetchall()[0][0]
    assert all(r.round_trip for r in out)


def test_empty_table(spark):
    assert p.encode(spark.createDataFrame([], DOCS)).count() == 0


def test_a_vocabulary_goes_without_a_collection_of_cycles():
    v = toy()
    assert v.encode_many([p.SPACE + "abba ab"]).to_pylist() == [np.frombuffer(v.encode(p.SPACE + "abba ab"), np.int32).tolist()]
    gc.collect()
    gc.disable()
    try:
        gone = weakref.ref(v)
        del v
        assert gone() is None
    finally:
        gc.enable()
