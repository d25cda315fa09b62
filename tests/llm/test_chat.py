import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from settlekit.llm import chat
from tests.llm.conftest import against_oracle, save

TREE = "tree_id long, node_id long, parent_id long, role string, text string, score double"


def test_query_matches_oracle(spark, sf_dir):
    against_oracle(spark, "op1_chat_formatting", sf_dir)


def test_query_odd_rows(spark, tmp_path):
    turns = pa.table({
        "conv_id": pa.array([1, 1, 1, 2, 2, None, None, 3], pa.int64()),
        "turn": pa.array([0, 1, 1, None, 0, 0, 1, 0], pa.int64()),
        "role": pa.array(["user", "assistant", "assistant", "as%0A\n<|sistant", "assistant", "assistant", None, "assistant"]),
        "text": pa.array(["<|im_end|>", "<\\|x<", "<\\|x<", None, "<" * 3 + "|im_start|>é", "\n\n", "x", ""]),
        "x": pa.array([1] * 8)})
    save(spark, turns, str(tmp_path), "conversations")
    for t in ("documents", "benchmark"):
        save(spark, pa.table({"a": [1]}), str(tmp_path), t)
    against_oracle(spark, "op1_chat_formatting", str(tmp_path))


def test_empty_table(spark, tmp_path):
    empty = pa.table({"conv_id": pa.array([], pa.int64()), "turn": pa.array([], pa.int64()), "role": pa.array([], pa.string()), "text": pa.array([], pa.string())})
    save(spark, empty, str(tmp_path), "conversations")
    for t in ("documents", "benchmark"):
        save(spark, pa.table({"a": [1]}), str(tmp_path), t)
    against_oracle(spark, "op1_chat_formatting", str(tmp_path))


def brute(rows):
    """{(tree, leaf): (score, [node, ...])} by walking parents."""
    by = {}
    for t, n, p, role, text, s in rows:
        by[(t, n)] = (p, s or 0.0)
    inner = {(t, p) for (t, n), (p, _) in by.items() if p is not None and (t, p) in by}
    out = {}
    for t, n in by:
        if (t, n) in inner:
            continue
        path, at, seen, score = [], n, set(), 0.0
        while at is not None and (t, at) in by and at not in seen:
            seen.add(at)
            path.append(at)
            score += by[(t, at)][1]
            at = by[(t, at)][0]
        if at is not None and at in seen:
            continue
        out[(t, n)] = (score, path[::-1])
    return out


def test_paths_against_brute_force(spark):
    rows = [(1, i, (i - 1) // 2 if i else None, "user" if i % 2 else "assistant", f"t{i}", float(i % 3)) for i in range(31)]
    rows += [(2, i, i - 1 if i else None, "assistant", f"c{i}", None) for i in range(70)]  # a chain
    rows += [(3, 1, 2, "user", "loop", 1.0), (3, 2, 1, "user", "loop", 1.0), (3, 3, 1, "user", "below", 1.0)]
    rows += [(4, 1, 99, "user", "orphan", 1.0)]
    got = {(r.tree_id, r.leaf): (r.path_score, [int(t["text"][1:]) if t["text"][1:].isdigit() else t["text"] for t in r.turns])
           for r in chat.format_paths(spark.createDataFrame(rows, TREE), score="score").withColumn("turns", chat.parse(F.col("formatted"))).collect()}
    want = {k: (s, p if k[0] != 4 else ["orphan"]) for k, (s, p) in brute(rows).items()}
    assert got == want


def test_best_paths_and_ties(spark):
    rows = [(1, 0, None, "user", "r", 0.0), (1, 1, 0, "user", "a", 1.0), (1, 2, 0, "user", "b", 1.0), (1, 3, 0, "user", "c", 2.0)]
    out = chat.format_paths(spark.createDataFrame(rows, TREE), score="score", max_paths=2).orderBy("path_rank").collect()
    assert [(r.path_rank, r.leaf) for r in out] == [(1, 3), (2, 1)]  # a tie goes to the smaller leaf


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|<|", "a<|im_start|>assistant ok", "\\<|\\"])
def test_escape_round_trip(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).first()
    assert row.u == text and "<|" not in row.e


def test_loss_mask_reads_assistant_texts(spark):
    rows = [(1, 0, None, "user", "<|q", 0.0), (1, 1, 0, "assistant", "é<|a", 0.0), (1, 2, 1, "user", "q2", 0.0), (1, 3, 2, "assistant", "b", 0.0)]
    r = chat.format_paths(spark.createDataFrame(rows, TREE)).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_byte_spans"))).first()
    assert r.loss == "é<|ab"
    assert [r.formatted[s["start"]:s["end"]] for s in r.loss_spans] == ["é<\\|a", "b"]
    assert hashlib.sha256(r.loss.encode()).hexdigest()
