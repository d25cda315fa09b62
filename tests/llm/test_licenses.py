import math
import re
from collections import Counter

import duckdb

from settlekit.llm import licenses as lic
from settlekit.llm.queries import QUERIES

FILES = "path string, text string, n long"


def brute(files, threshold=0.85, share=0.5):
    """[(license, origin, directory)] of each (path, text), every line against every template."""
    tokens = lambda t: re.findall(lic._TERM, t.lower())
    counted = lic.template_terms(lic.TEMPLATES)
    vocabulary = {t for c in counted.values() for t in c}
    df = Counter(t for _, x in files for t in set(tokens(x or "")) & vocabulary)
    idf = {t: math.log((1 + len(files)) / (1 + df[t])) + 1 for t in vocabulary}

    def best(line):
        c = Counter(tokens(line))
        size = math.sqrt(sum((n * idf[t]) ** 2 if t in idf else n for t, n in c.items()))
        out = []
        for name, v in counted.items():
            norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in v.items()))
            s = round(sum(n * v[t] * idf[t] ** 2 for t, n in c.items() if t in v) / (norm * size), 9) if size else 0
            if s >= threshold:
                out.append((-s, name, len(line.split())))
        return min(out) if out else None

    own = []
    for path, text in files:
        found = [b for b in map(best, (text or "").split("\n")) if b]
        words = sum(b[2] for b in found)
        top = min(found)[:2] if found else None
        path = path or ""
        d, name = path.rpartition("/")[0], path.rpartition("/")[2]
        own.append((top, d, bool(top) and (bool(re.match(lic.NAMES, name)) or words >= share * len((text or "").split()))))
    rules = {}
    for top, d, is_file in own:
        if is_file:
            rules[d] = min(rules.get(d, top), top)
    out = []
    for top, d, is_file in own:
        if top:
            out.append((top[1], "file" if is_file else "header", None))
            continue
        at = d
        while at not in rules and at:
            at = at.rpartition("/")[0]
        out.append((rules[at][1], "inherited", at) if at in rules else (None, "none", None))
    return out


def test_query_against_brute_force(spark, sf_dir):
    rows = duckdb.sql(f"SELECT doc_id, source, text FROM '{sf_dir}/documents.parquet'").fetchall()
    want = brute([(f"{s}/{i // 1000}/{i // 100}/{i}.txt", t) for i, s, t in rows])
    got = {r.doc_id: (r.license, r.origin, r.license_dir) for r in QUERIES["op4_license_scan"](spark, sf_dir).collect()}
    assert got == {i: w for (i, _, _), w in zip(rows, want)}
    assert {"header", "none"} <= {w[1] for w in want}


def test_directories_and_odd_rows(spark):
    mit, apache, gpl = (lic.TEMPLATES[x] for x in ("MIT", "Apache-2.0", "GPL-3.0"))
    body = "some code here\n" * 9
    files = [("LICENSE", mit + "\n" + body), ("a/x.c", body), ("a/b/LICENSE.txt", apache), ("a/b/c/d/y.c", body), ("a/b/z.c", f"// {gpl.upper()}\n" + body),
             ("a/bc/q.c", ""), ("a/b/c/COPYING", body), ("e/NOTICE", mit + "\n" + gpl), ("e/n.c", None), (None, "text"), ("e/f/", "x"), ("/abs/t.c", "y"),
             ("g/h.c", "the license of this work is not public here at all"), ("g/i.c", "under the terms of the version"), ("a/x.c", body), ("long/l.c", "word " * 60000 + "\n" + gpl)]
    df = spark.createDataFrame([(p, t, i) for i, (p, t) in enumerate(files)], FILES)
    out = lic.scan(df)
    got = {r.n: (r.license, r.origin, r.license_dir) for r in out.collect()}
    assert [got[i] for i in range(len(files))] == brute(files)
    assert got[1] == ("MIT", "inherited", "") and got[3] == ("Apache-2.0", "inherited", "a/b") and got[4][:2] == ("GPL-3.0", "header") and got[15][0] == "GPL-3.0"


def test_empty_table_and_clashing_columns(spark):
    assert lic.scan(spark.createDataFrame([], FILES)).count() == 0
    r = lic.scan(spark.createDataFrame([("a", "x", "mine", "l")], "path string, text string, license string, line string")).first()
    assert r.license is None and r.line == "l" and r.origin == "none"
