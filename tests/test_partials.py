"""KPIs from partial aggregates equal those of the whole analysis; a refresh
reads the months that changed."""

import datetime as dt
import tempfile
from decimal import Decimal

from pyspark.sql import functions as F

from settlekit import schema as S
from settlekit import sinks
from settlekit.operators import metrics as M
from settlekit.operators import partials as PA

SCHEMA = ("order_release_id string, settlement_month string, status string, status_group string, status_changed_this_run boolean, "
          "created_on timestamp, " + ", ".join(f"{c} decimal(28,4)" for c in PA.SUMS))
STATUSES = [S.DELIVERED_SETTLED, S.DELIVERED_PENDING, "x"]


def analysis(spark, rows):
    full = [(f"o{i}", m, STATUSES[s % 3], S.GROUP_CANCELLED if s == 2 else "g", bool(ch), dt.datetime(2025, 1, 1),
             *[None if i % 5 == 0 and c == "net_revenue" else Decimal(i * 10 + k) for k, c in enumerate(PA.SUMS)]) for i, m, s, ch in rows]
    return spark.createDataFrame(full, SCHEMA)


def written(spark, rows):
    path = tempfile.mkdtemp(prefix="pa-") + "/a"
    sinks.write_analysis(analysis(spark, rows), path)
    return spark.read.parquet(path)


MONTHS = ["2025-01", "2025-02", "2025-03", None]
FIRST = [(i, MONTHS[i % 4], i % 3, i % 7 == 0) for i in range(60)]


def test_all_denominators_and_no_rows(spark):
    a = analysis(spark, FIRST)
    for df in (a, a.limit(0)):
        for den in ("all", "active"):
            got, want = PA.summary_row(PA.partials(df), den).first(), M.summary_row(df, den).first()
            assert all(got[c] == want[c] for c in got.asDict())


def test_a_refresh_reads_touched_months_and_takes_flags_back(spark):
    root = tempfile.mkdtemp(prefix="kpi-")
    old = written(spark, FIRST)
    PA.refresh(old, root)
    # a second run: order 1 settles, order 2 moves to another month, order 99 is new; nothing else changed in this run
    rows = [(i, m, s, False) for i, m, s, _ in FIRST if i not in (1, 2)] + [(1, MONTHS[1], 0, True), (2, "2025-02", 2, False), (99, "2025-04", 1, True)]
    new = written(spark, rows)
    months = PA.touched_months([new, old], spark.createDataFrame([("o1",), ("o2",), ("o99",)], "order_release_id string"))
    assert sorted(months) == ["2025-02", "2025-03", "2025-04"]
    got = PA.summary_row(PA.refresh(new, root, months)).first()
    want = M.summary_row(new).first()
    assert all(got[c] == want[c] for c in got.asDict())
    # the other months' files are pruned
    plan = PA.in_months(new, months)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [settlement_month" in plan
    read = {f.split("settlement_month=")[1].split("/")[0] for f in PA.in_months(new, months).select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert read == set(months)


def test_a_month_that_lost_its_orders_and_the_missing_month(spark):
    root = tempfile.mkdtemp(prefix="kpi-")
    PA.refresh(written(spark, FIRST), root)
    rows = [(i, m, s, False) for i, m, s, _ in FIRST if m not in (None, "2025-01")] + [(7, None, 1, True)]
    new = written(spark, rows)
    got = PA.refresh(new, root, [None, "2025-01"])
    assert {r[0] for r in got.select("settlement_month").distinct().collect()} == {"2025-02", "2025-03", None}
    assert PA.summary_row(got).first()["total_orders"] == len(rows) == PA.summary_row(PA.stored(spark, root)).first()["total_orders"]
