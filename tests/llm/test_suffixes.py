import hashlib
import random

import duckdb

from settlekit.llm import suffixes as sx
from settlekit.llm.queries import QUERIES
from tests.llm.conftest import DOCS


def brute(rows, length=50):
    """{doc_id: [(start, end)]}: words in a run of ``length`` that another document also has."""
    import re
    where, toks = {}, {}
    for i, t in rows:
        toks[i] = [(m.start(), m.end(), "".join(c.lower() if c.isascii() else c for c in m[0])) for m in re.finditer(r"[^\x09-\x0d ]+", t or "")]
        w = [x[2] for x in toks[i]]
        for j in range(len(w) - length + 1):
            where.setdefault(tuple(w[j:j + length]), set()).add(i)
    out = {}
    for i, _ in rows:
        w = [x[2] for x in toks[i]]
        spans = sx.merged([(j, j + length) for j in range(len(w) - length + 1) if len(where[tuple(w[j:j + length])]) > 1])
        out[i] = [(toks[i][a][0], toks[i][b - 1][1]) for a, b in spans]
    return out


def found(spark, rows, **options):
    out = sx.repeated_passages(spark.createDataFrame(rows, DOCS), **options).collect()
    assert len(out) == len(rows)
    return {r.doc_id: [(s["start"], s["end"]) for s in r.spans] for r in out}, {r.doc_id: r.text for r in out}


def test_query_against_brute_force(spark, sf_dir):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    want = brute(rows)
    got = QUERIES["op5_suffix_dedup"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.spans for r in got} == {i: ",".join(f"{a}:{b}" for a, b in s) for i, s in want.items()}
    text = dict(rows)
    for r in got:
        if not want[r.doc_id]:
            assert r.kept_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() and r.repeated_words == 0


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "é"]) if rng.random() < 0.5 else f"w{rng.randrange(500)}" for _ in range(n))


def test_planted_passages(spark):
    rng = random.Random(6)
    short, a, b, c = prose(rng, 49), prose(rng, 50), prose(rng, 75), prose(rng, 300)
    rows = [(i, prose(rng, rng.randrange(0, 200)) + "\n" + p + " " + prose(rng, rng.randrange(0, 120)))
            for i, p in enumerate([short, short, a, a.upper().replace("É", "é"), b, b, c, c, "", c[:len(c) // 2], a + " " + b] + [b] * 60)]
    got, text = found(spark, rows)
    assert got == brute(rows)
    assert not got[0] and not got[1] and got[2] and got[3]
    # the first document keeps its passage, later ones lose it
    assert text[2] == rows[2][1] and a.lower() not in text[3].lower() and b in text[4] and all(b not in text[i] for i in (5, 20, 70))


def test_groups_of_copies_and_near_copies(spark):
    rng = random.Random(7)
    base = prose(rng, 120).split(" ")
    rows = [(i, prose(rng, 100)) for i in range(40)] + [(100 + i, " ".join(base)) for i in range(30)]
    for i in range(40):  # one word changed at varying places
        near = list(base)
        near[rng.randrange(120)] = f"new{i}"
        rows.append((200 + i, " ".join(near)))
    got, text = found(spark, rows)
    assert got == brute(rows)
    assert text[100] == " ".join(base) and all(text[100 + i] == "" for i in range(1, 30))


def test_partners_hidden_by_others_that_agree_on_one_side(spark):
    rng = random.Random(11)
    own = lambda n: " ".join(f"z{rng.randrange(10 ** 9)}" for _ in range(n))
    rows = []
    for family in range(3):
        begins, ends, middle = [own(6) for _ in range(10)], [own(6) for _ in range(10)], own(40)
        rows += [(1000 * family + i, " ".join((own(20), rng.choice(begins), middle, rng.choice(ends), own(20)))) for i in range(300)]
    rng.shuffle(rows)
    want = brute(rows)
    got, text = found(spark, rows)
    assert got == want
    # one copy of each passage stays
    firsts, seen = set(), set()
    for i, t in sorted(rows):
        passage = " ".join(t.split(" ")[20:72])
        if want[i] and passage not in seen:
            seen.add(passage)
            firsts.add(i)
    assert {i for i, t in rows if want[i] and text[i] == t} == firsts


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, "a " * 70000), (4, long), (None, long), (5, "é🙂 " + long + "\n"), (6, long + " " + long)]
    got, text = found(spark, rows)
    assert got[1] == got[2] == [] and got[3] == [] and got[4] == got[None] == [(0, len(long))] and got[5] == [(3, 3 + len(long))]
    assert got[6] == [(0, 2 * len(long) + 1)] and text[None] == long and text[4] == "" and text[5] == "é🙂 \n"
    named = spark.createDataFrame([(1, long, 5, "q")], "doc_id long, text string, spans int, r1 string")
    assert sx.repeated_passages(named).first().text == long
    twice = sx.repeated_passages(spark.createDataFrame([(1, long), (1, long)], DOCS)).collect()
    assert sorted(r.text for r in twice) == ["", long]
    assert sx.repeated_passages(spark.createDataFrame([], DOCS)).count() == 0
