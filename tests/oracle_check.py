"""Run every registered query in Spark and its oracle in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]

Comparison: column names (sorted), row count, and the multiset of rows with
exact values (floats compared by repr, so a last-bit difference shows up).
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    try:
        import pandas as pd
        if v is pd.NaT or v is pd.NA:
            return None
    except Exception:  # pragma: no cover
        pass
    if isinstance(v, float):
        return None if math.isnan(v) else repr(float(v))
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def rows(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(v) for v in rec))
    out.sort(key=lambda t: tuple("" if x is None else x for x in t))
    return cols, out


def compare(spark_pdf, duck_pdf):
    sc, sr = rows(spark_pdf)
    dc, dr = rows(duck_pdf)
    if sc != dc:
        return f"columns differ: spark={sc} duck={dc}"
    if len(sr) != len(dr):
        return f"row count spark={len(sr)} duck={len(dr)}"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        a, b = bad[0]
        diff = [(c, x, y) for c, x, y in zip(sc, a, b) if x != y]
        return f"{len(bad)} rows differ; first: {diff[:4]}"
    kinds = [(c, str(spark_pdf[c].dtype), str(duck_pdf[c].dtype)) for c in sc
             if str(spark_pdf[c].dtype) != str(duck_pdf[c].dtype)]
    return f"ok ({len(sr)} rows){' dtype ' + str(kinds) if kinds else ''}"


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from settlekit.session import get_session
    spark = get_session("local[8]", 8)
    qs, oracle = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    failures = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            spdf = fn(spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} SPARK ERROR {type(e).__name__}: {str(e)[:300]}")
            failures += 1
            continue
        st = time.time() - t
        sql = oracle.get(name)
        if not sql:
            print(f"{name:28s} rows-only {len(spdf)} rows ({st:.1f}s)")
            continue
        try:
            dpdf = con.sql(sql).df()
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} DUCKDB ERROR {str(e)[:300]}")
            failures += 1
            continue
        res = compare(spdf, dpdf)
        if not res.startswith("ok"):
            failures += 1
        print(f"{name:28s} {res} ({st:.1f}s)")
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
