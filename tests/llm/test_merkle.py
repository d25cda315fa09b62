import random
from hashlib import sha256
from zlib import crc32

import pyarrow as pa
from pyspark.sql import functions as F

from settlekit.llm import merkle
from tests.llm.conftest import against_oracle, save

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(s):
    return sha256(s.encode()).hexdigest()


def framed(*fields):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree(level):
    """Top of the tree over ``level`` and each leaf's path of (before, after)."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 3 * 3:i // 3 * 3 + 3]
            paths[k].append((run[:i % 3], run[i % 3 + 1:]))
        level, at = [h("".join(level[j:j + 3])) for j in range(0, len(level), 3)], [i // 3 for i in at]
    return level[0], paths


def brute(docs):
    leaf = [framed(i, s, lang, n, t) for i, t, lang, s, n in docs]
    shown = [framed(i, s, lang, n, t.replace("\n", "")) if t is not None and i is not None and crc32(str(i).encode()) % 2 == 0 else x
             for (i, t, lang, s, n), x in zip(docs, leaf)]
    names = sorted({d[3] for d in docs}, key=lambda s: (s is not None, (s or "").encode()))
    rows, tops = [], []
    for name in names:
        mine = sorted((k for k, d in enumerate(docs) if d[3] == name), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0, leaf[k]))
        top, paths = tree([leaf[k] for k in mine])
        rows.append((mine, top, paths))
        tops.append(top)
    root, above = tree(tops)
    out = []
    for (mine, top, paths), up in zip(rows, above):
        for k, path in zip(mine, paths):
            cur, proof = shown[k], ""
            for before, after in path + up:
                cur, proof = h("".join(before) + cur + "".join(after)), proof + "".join(before + after)
            out.append((docs[k][0], leaf[k], top, root, h(proof), cur, cur == root))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def odd_docs():
    rng = random.Random(8)
    docs = [(i, rng.choice(["a\nb", "é", "", None, f"t{i}\n"]), rng.choice(["en", None]), "hot" if i % 3 else f"s{i % 11}", rng.choice([i, None])) for i in range(2300)]
    docs += [(7, "same\n", "en", None, 5)] * 5 + [(None, "x\n", None, None, None)] * 2 + [(8000, "long\n" * 300_000, "de", "z", 1), (1 << 40, "y", "", "", 0)]
    rng.shuffle(docs)
    return docs


def test_odd_rows_match_brute_force_and_oracle(spark, tmp_path):
    docs = odd_docs()
    got = merkle.manifest(spark.createDataFrame(docs, DOCS).withColumns({"rank": F.lit(1), "digest": F.lit("x"), "size": F.lit(2)}))
    assert rows(got) == brute(docs)
    save(spark, pa.table({n: pa.array(c, pa.string() if n in ("text", "lang", "source") else pa.int64())
                          for n, c in zip(("doc_id", "text", "lang", "source", "n_chars"), zip(*docs))}), str(tmp_path), "documents")
    against_oracle(spark, "op13_merkle_manifest", str(tmp_path))


def test_sizes_around_the_powers_of_three(spark):
    for n in (1, 2, 3, 4, 9, 10, 27, 28):
        docs = [(i, f"{i}\n", "en", "a" if i else "b", i) for i in range(n)]
        assert rows(merkle.manifest(spark.createDataFrame(docs, DOCS))) == brute(docs)


def test_packs_of_several_stages_and_many_sources(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    monkeypatch.setattr(merkle, "WIDTH", 3)
    docs = [(i, f"{i % 5}\n", None, None if i % 4 == 0 else f"s{i % 10}", 1) for i in range(60)]
    assert rows(merkle.manifest(spark.createDataFrame(docs, DOCS))) == brute(docs)


def test_query_matches_oracle(spark, sf_dir):
    against_oracle(spark, "op13_merkle_manifest", sf_dir)


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []
