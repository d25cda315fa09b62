"""Driver contract: entry() runs; every query with an oracle matches DuckDB
at sf0.001 (the driver checks sf0.01)."""

import re

import pytest

import __spark_entry__ as E
from tests.conftest import SMALL
from tests.oracle_check import compare, duck


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"status", "profit_loss", "status_group"} <= set(df.columns)


def own(names):
    """Queries of this part of the library (optional packages have their own tests)."""
    return sorted(n for n in names if not re.match(r"op\d+_|pipeline$", n))


def test_every_query_has_an_oracle():
    assert own(E.queries()) == own(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", own(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    from settlekit.plans.explain import facts
    df = E.queries()[name](spark, SMALL)
    f = facts(df._jdf.queryExecution().executedPlan())
    assert f["pairs"] == 0 and f["python"] == 0, (name, f)
    got = df.toPandas()
    want = con.sql(E.oracle_sql()[name]).df()
    assert compare(got, want).startswith("ok"), name


def test_contract_is_importable_without_spark():
    """The driver may read oracle_sql() before any session exists."""
    import subprocess
    import sys
    code = ("import sys; sys.path.insert(0, %r); import __spark_entry__ as E; "
            "from pyspark.sql import SparkSession; o = E.oracle_sql(); q = E.queries(); "
            "assert set(o) <= set(q) and SparkSession.getActiveSession() is None; print(len(o))") % E._HERE
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout) >= 100, out.stderr[-500:]
