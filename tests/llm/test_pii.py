import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from settlekit.llm import pii
from settlekit.llm.queries import QUERIES
from tests.llm.conftest import DOCS

RX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
      "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, rx in RX.items() for m in re.finditer(rx, text or "") if ok(k, m[0])]


TEXTS = [None, "", "no data", "a@b.c@d.e a@b.cd%x@e.f", "é 1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.002.3.4 1.2.3",
         "4111 1111 1111 1111 and 4111111111111112 or 4-1-1-1-1111111111111", "call +1 (555) 010-9999 now +12 +123456789012345678",
         "x" * 5000 + "@", "1" * 20000, "a.b@c-d.ef\n+49 30 1234567\t10.0.0.1", "é" * 3 + "q@w.er.", "+1..............2 +1 234 567 8901-",
         "1.2.3.4@5.6.7", "4111 1111 1111 1111" * 3, "999999999999999999999999.1.1.1", "-".join("1" * 3000)]


def test_base_spans_against_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], DOCS)
    out = {r.doc_id: r.b for r in pii.find_pii(df).select("doc_id", pii.span_text(F.col("base")).alias("b")).collect()}
    assert out == {i: ",".join(brute(t)) for i, t in enumerate(TEXTS)}


def test_query_against_brute_force(spark, sf_dir):
    want = {i: brute(t) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()}
    got = QUERIES["op9_pii"](spark, sf_dir).collect()
    assert len(got) == len(want)
    for r in got:
        spans = want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in RX]


def test_contexts_discover_unseen_identifiers(spark):
    known = [(i, f"please reach contact: someone{i}@mail{i}.example.org today") for i in range(12)]
    hidden = [(100, "please reach contact: jane@corp today"), (101, "room 1234 and jane@corp elsewhere"), (102, "contact: 7")]
    # the copies add rows but no weight to the graph
    out = {r.doc_id: r.s for r in pii.find_pii(spark.createDataFrame(known + hidden + [known[0]] * 50, DOCS)).select("doc_id", pii.span_text(F.col("spans")).alias("s")).distinct().collect()}
    assert out[100] == "email:22:31"
    assert out[101] == "" and out[102] == ""


def test_empty_table_and_clashing_columns(spark):
    assert pii.find_pii(spark.createDataFrame([], DOCS)).count() == 0
    r = pii.find_pii(spark.createDataFrame([(1, "a@b.cd", "z", "q")], "doc_id long, text string, spans string, tokens string")).first()
    assert r.tokens == "q" and len(r.spans) == 1


def test_a_long_text_with_many_matches_takes_linear_time(spark):
    import re
    import time
    n = 100_000
    text = " ".join(f"a {i}" if i % 50 else f"u{i}@ex.org 10.0.{i % 256}.1" for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").repartition(1).cache()
    df.count()
    began = time.time()
    got = df.select(F.size(pii.located(F.col("text"), pii.TOKEN, 64)).alias("t"), pii.base_spans(F.col("text")).alias("b")).first()
    assert time.time() - began < 60
    assert got.t == n + n // 50
    emails = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ips = [(m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)]
    assert [(x["start"], x["end"]) for x in got.b if x["k"] == 0] == emails and [(x["start"], x["end"]) for x in got.b if x["k"] == 1] == ips
