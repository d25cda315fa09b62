import zlib

import duckdb
import numpy as np

from settlekit.llm import langid
from settlekit.llm.queries import QUERIES

ROWS = "doc_id long, text string, lang string"


def test_held_out_accuracy_and_split(spark, sf_dir):
    truth = {i: lang for i, lang in duckdb.sql(f"SELECT doc_id, lang FROM '{sf_dir}/documents.parquet'").fetchall()}
    out = QUERIES["op3_language_id"](spark, sf_dir).collect()
    assert len(out) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_only_the_text_decides(spark):
    docs = spark.createDataFrame([(i, t, lang) for i in range(120) for t, lang in [("the cat and the dog", "en")] * (i % 2) + [("der hund und die katze", "de")] * (1 - i % 2)], ROWS)
    model = langid.train(docs, per_language=30)
    asked = spark.createDataFrame([(1, "the dog", "de"), (2, "die katze", None), (3, None, "en"), (4, "", "en"), (5, "123 ... !?", "en"), (6, "the cat " * 40000, "de")], ROWS)
    out = {r.doc_id: (r.lang_pred, r.score > 0.5) for r in langid.predict(asked, model).collect()}
    assert out == {1: ("en", True), 2: ("de", True), 3: ("und", False), 4: ("und", False), 5: ("und", False), 6: ("en", True)}


def test_nothing_to_learn_and_clashing_columns(spark):
    assert langid.identified(spark.createDataFrame([], ROWS)).count() == 0
    docs = spark.createDataFrame([(None, "abc", "en", "x", [1]), (3, "abc", None, "y", [2])], "doc_id long, text string, lang string, score string, held array<int>")
    out = langid.identified(docs).orderBy("held").collect()
    assert [(r.lang_pred, r.score, r.held_out) for r in out] == [("und", 0.0, False), ("und", 0.0, zlib.crc32(b"3") % 5 == 0)]


def test_counts_do_not_depend_on_blocks(monkeypatch):
    text = "Ünï  cödé\n" + "abcde" * 30
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "BLOCK", 7)
    small = langid.counts(text)
    assert (whole[0] == small[0]).all() and (whole[1] == small[1]).all()
    n = len(langid._SPACES.sub(" ", text.lower()))
    assert whole[1].sum() == n + n - 1 + n - 2


def test_ftrl_penalty_makes_weights_sparse():
    rng = np.random.default_rng(0)
    samples = [(int(y), np.array([10 + int(y), 20 + rng.integers(100)]), np.array([0.9, 0.1])) for y in rng.integers(0, 2, 400)]
    loose, _ = langid.ftrl(samples, 2, l1=0.0)
    tight, _ = langid.ftrl(samples, 2, l1=1.0)
    assert (tight != 0).sum() < (loose != 0).sum() and tight[10, 0] > 0 > tight[11, 0]


def test_temperature_finds_the_scale():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert abs(langid.calibrate(logits * 4, y) - 4) < 0.6


def test_no_language_is_left_out(spark):
    # more languages than the sample has room for at per_language texts each; copies are drawn once
    rows = [(i, f"{chr(97 + n // 26) * 3}{chr(97 + n % 26) * 4} " * 6 + str(i % 3), f"l{n:03}") for n in range(230) for i in range(n * 4, n * 4 + 4)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=400)
    assert model.labels == [f"l{n:03}" for n in range(230)]
    assert sum(model.predict(t)[0] == lang for _, t, lang in rows) >= 0.9 * len(rows)
