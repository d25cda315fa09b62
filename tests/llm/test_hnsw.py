import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from settlekit.llm import hnsw
from settlekit.llm.queries import QUERIES
from tests.llm.conftest import save

VECTORS = "vec_id long, embedding array<double>"


def brute(vectors, every=100, k=10):
    """Every query against every vector, in double precision."""
    fit = {}
    for i, v in vectors:
        if i is None or v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        v = [float(x) for x in v]
        fit[i] = min(fit.get(i, v), v)
    out = {}
    for dim in {len(v) for v in fit.values()}:
        ids = np.array(sorted(i for i, v in fit.items() if len(v) == dim))
        x = np.array([fit[i] for i in ids])
        for i in ids[ids % every == 0]:
            d = np.sqrt(((x - np.array(fit[i])) ** 2).sum(1))
            near = [(d[j], ids[j]) for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[int(i)] = [(int(j), float(s)) for s, j in near]
    return {i: v for i, v in out.items() if v}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in v}) / len(v) for q, v in want.items()])


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_query_recall(spark, folder):
    t = pd.read_parquet(f"{folder}/embeddings.parquet")
    rows = list(zip(t["vec_id"].tolist(), t["embedding"]))
    got, want = found(QUERIES["op12_nearest_neighbours"](spark, folder)), brute(rows)
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    assert recall(got, want) >= 0.97
    exact = dict(rows)
    for q, near in got.items():
        for i, s in near:
            assert s == pytest.approx(np.sqrt(((np.asarray(exact[q], float) - np.asarray(exact[i], float)) ** 2).sum()), rel=1e-12)


def test_several_shards_and_tiles_of_uniform_vectors(spark):
    """The hardest case: no clusters at all."""
    x = np.random.default_rng(4).normal(size=(6000, 32))
    rows = list(enumerate(x.tolist()))
    df = spark.createDataFrame(rows, VECTORS)
    clean = hnsw.clean_vectors(df)
    index, shards = hnsw.build_index(clean, shard_floats=1 << 16)
    assert shards == 3 and index.count() == 3
    got = found(hnsw.search(index, shards, clean.where("vec_id % 100 = 0"), tile=25))
    want = brute(rows)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-3, 4, 4).tolist()) for i in range(0, 1200, 7)]
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    rows += [(100, None), (200, []), (300, [0.0, 0.0, -0.0]), (400, [1.0, None, 1.0, 1.0]), (500, [float("nan")] * 4), (600, [float("inf"), 1.0, 1.0, 1.0]),
             (None, [1.0] * 4), (800, [1.0, 2.0]), (801, [1.0, 2.5]), (900, [3.0, 1.0, 2.0]), (1003, [1e300, 1.0, 0.0, -1e300]), (1004, [1e300, 2.0, 0.0, -1e300]),
             (1100, [1.0, -0.0, 0.0, 2.0]), (1102, [1.0, 0.0, 0.0, 2.0]), (0, [9.0] * 4), (0, [9.0] * 4)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"shard": F.lit(1), "rank": F.lit("x"), "dim": F.lit(2), "ids": F.array(F.lit(1))})
    want = brute(rows)
    assert 900 not in want and want[800] == [(801, 0.5)] and (1102, 0.0) == want[1100][0]
    with np.errstate(over="ignore"):
        same(found(hnsw.neighbours(df)), want)
    assert hnsw.neighbours(df.limit(0)).collect() == [] == hnsw.neighbours(df.where("vec_id = 900")).collect()


def test_one_vector_in_a_third_of_all_rows(spark):
    x = np.random.default_rng(3).normal(size=(3000, 8)).round(3)
    x[::3] = x[0]
    rows = list(enumerate(x.tolist()))
    got, want = found(hnsw.neighbours(spark.createDataFrame(rows, VECTORS))), brute(rows)
    assert recall(got, want) >= 0.98
    assert [i for i, _ in got[300]] == [i for i, _ in want[300]] == [3 * j for j in range(10)]


def test_float_vectors_of_a_table(spark, tmp_path):
    x = np.random.default_rng(6).normal(size=(30, 5)).astype(np.float32)
    save(spark, pa.table({"vec_id": pa.array(range(30), pa.int64()), "embedding": pa.array(x.tolist(), pa.list_(pa.float32())), "label": [None] * 30}), str(tmp_path), "embeddings")
    same(found(QUERIES["op12_nearest_neighbours"](spark, str(tmp_path))), brute(list(enumerate(x.astype(float).tolist()))))
