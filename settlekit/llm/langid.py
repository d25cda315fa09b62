"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained with follow-the-regularised-leader (FTRL-Proximal,
elastic net) and calibrated by a temperature.

Features are the 1- to 3-grams of the lower-cased text, white space runs as one
space, hashed into ``2 ** BITS`` bins; a bin weighs (1 + ln count) * idf, the
vector has length 1. Document frequencies cover all learning documents. The
classifier is fitted on a bounded sample of them, drawn by the hash of text and
language: at most ``per_language`` different texts of each language, and fewer
of each where the languages are so many that it would be over ``sample`` texts
(one of each language at least); no language is left out. Every tenth text of
a language sets the temperature instead. The fit runs in one task, whose input that
bound limits; its weights take 2 ** BITS numbers a language.

Defined results: a text that is null or has no letter is ``und`` with score 0,
and so is every text when there is nothing to learn from; ties between
languages go to the alphabetically first; null languages are not learned;
whole texts count, however long; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from settlekit.llm.common import fresh_columns, row_key, shipped, written

BITS = 15
BLOCK = 1 << 20
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SPACES = re.compile(r"\s+")


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bins, counts) of the n-grams of a text, in blocks of bounded size."""
    text = _SPACES.sub(" ", text.lower())
    total = np.zeros(1 << BITS, np.int64)
    for a in range(0, len(text), BLOCK):
        cp = np.frombuffer(text[max(0, a - 2):a + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        old = min(a, 2)  # characters of the block before, for n-grams over the border
        grams = cp * _K[0]
        for n in range(1, 4):
            if n > 1:
                if len(cp) < n:
                    break
                grams = (grams[:-1] ^ (grams[:-1] >> np.uint64(29))) * _K[1] + cp[n - 1:] * _K[n - 1]
            new = grams[max(0, old - n + 1):]
            total += np.bincount(((new + np.uint64(n)) * _K[0] >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    bins = np.flatnonzero(total)
    return bins, total[bins]


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bins, n = counts(text)
    x = (1 + np.log(n)) * idf[bins]
    size = np.sqrt((x * x).sum())
    return bins, x / size if size else x


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    """labels in alphabetical order, idf by bin, weights (bins x labels), bias, temperature."""
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or not has_letter(text):
            return "und", 0.0
        bins, x = features(text, self.idf)
        p = softmax((x @ self.weights[bins] + self.bias) / self.temperature)
        best = int(np.argmax(p))
        return self.labels[best], float(p[best])


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max())
    return e / e.sum()


def ftrl(samples: list[tuple[int, np.ndarray, np.ndarray]], labels: int, alpha: float = 1.0, beta: float = 1.0,
         l1: float = 1e-4, l2: float = 1e-3, epochs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of FTRL-Proximal over (label, bins, values); the bias is
    a last feature of value 1 without penalty on its size."""
    z, n = np.zeros(((1 << BITS) + 1, labels)), np.zeros(((1 << BITS) + 1, labels))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for y, bins, x in samples:
            at, v = np.append(bins, 1 << BITS), np.append(x, 1.0)[:, None]
            w = weights(z[at], n[at])
            p = softmax((v * w).sum(axis=0))
            p[y] -= 1.0
            g = v * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(z, n)
    return w[:-1], w[-1]


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """Temperature with the smallest log loss, by golden-section search."""
    def loss(log_t: float) -> float:
        v = logits / np.exp(log_t)
        v = v - v.max(axis=1, keepdims=True)
        return float((np.log(np.exp(v).sum(axis=1)) - v[np.arange(len(y)), y]).mean())

    low, high, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _frequencies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    df, n = np.zeros(1 << BITS, np.int64), 0
    for f in frames:
        for t in f["text"]:
            df[counts(t)[0]] += 1
            n += 1
    bins = np.flatnonzero(df)
    yield pd.DataFrame({"bin": np.append(bins, -1), "n": np.append(df[bins], n)})


def _fit(idf: np.ndarray, labels: list[str], seed: int = 7):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["draw", "text"])  # one order, however the rows came
        made = (features(t, idf) for t in rows["text"])
        samples = [(labels.index(lang), bins.astype(np.int32), x) for lang, (bins, x) in zip(rows["lang"], made)]
        nth = rows.groupby("lang").cumcount().to_numpy() % 10
        held = [s for s, i in zip(samples, nth) if i == 9] or samples
        learn = [s for s, i in zip(samples, nth) if i < 9]
        np.random.default_rng(seed).shuffle(learn)
        w, bias = ftrl(learn, len(labels))
        logits = np.array([x @ w[bins] + bias for _, bins, x in held])
        t = calibrate(logits, np.array([y for y, _, _ in held]))
        bins = [np.flatnonzero(x) for x in w.T]
        yield pd.DataFrame({"label": range(len(labels)), "bias": bias, "temperature": t, "bins": bins, "weights": [x[b] for x, b in zip(w.T, bins)]})
    return run


def train(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 1500, sample: int = 300_000) -> Model:
    """A model from the rows of ``docs`` with a language and a letter in the text."""
    shipped(docs.sparkSession)
    known = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("draw", F.pmod(row_key(F.col("text"), F.col("lang"))[0], F.lit(1 << 40)))
    stats = known.select("text").mapInPandas(_frequencies, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()  # 2^BITS rows at most
    total = int(stats.loc[stats["bin"] < 0, "n"].sum())
    df = np.zeros(1 << BITS)
    df[stats.loc[stats["bin"] >= 0, "bin"]] = stats.loc[stats["bin"] >= 0, "n"]
    idf = np.log((1 + total) / (1 + df)) + 1
    # different texts by language; copies of a text have one draw
    sizes = written(known.select("lang", "draw").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("size")), "langid-sizes")
    labels = sorted(r["lang"] for r in sizes.select("lang").collect())
    if not labels:
        return Model([], idf, np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)
    most = max(1, min(per_language, sample // len(labels)))
    # a share of each language by hash, somewhat too many, then exactly the bound
    drawn = (known.join(F.broadcast(sizes), "lang").where(F.col("draw") < F.lit((1.5 * most + 10) * (1 << 40)) / F.col("size"))
             .groupBy("lang", "draw").agg(F.min("text").alias("text")))
    order = Window.partitionBy("lang").orderBy("draw", "text")
    chosen = drawn.withColumn("i", F.row_number().over(order)).where(F.col("i") <= most).select("lang", "text", "draw")
    fitted = written(chosen.repartition(1).mapInPandas(_fit(idf, labels), "label int, bias double, temperature double, bins array<int>, weights array<double>"), "langid-fit")
    weights, bias, temperature = np.zeros((1 << BITS, len(labels))), np.zeros(len(labels)), 1.0
    for r in fitted.toLocalIterator():  # a row for each label, its weights that are not 0
        weights[r["bins"], r["label"]], bias[r["label"]], temperature = r["weights"], r["bias"], r["temperature"]
    return Model(labels, idf, weights, bias, temperature)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only the text is looked at."""
    docs = fresh_columns(docs, "lang_pred", "score")
    shared = shipped(docs.sparkSession).sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def out(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn("__p", out(F.col(f"`{text}`"))).select(
        *[F.col(f"`{c}`") for c in docs.columns], F.col("__p.lang_pred").alias("lang_pred"), F.col("__p.score").alias("score"))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``, learned from the
    rows that have an id and are not held out."""
    docs = fresh_columns(docs, "held_out")
    column = F.col(f"`{doc_id}`")
    model = train(docs.where(column.isNotNull() & ~held_out(column)), text, lang, **options)
    return predict(docs.withColumn("held_out", held_out(column)), model, text)
