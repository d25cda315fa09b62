"""Row-level issues: which value of which row was replaced."""

import datetime as dt
import os
import tempfile

import pytest

from settlekit.operators import cleanse as CL
from settlekit.plans import batch as BT
from settlekit.session import settings
from settlekit.sources import csv as CSV

RUN_TS = dt.datetime(2025, 4, 1)
HEADER = "order_release_id,order_line_id,return_type,return_date,total_actual_settlement,upload_timestamp"


def landed(lines, name="returns-01-2025.csv"):
    root = tempfile.mkdtemp(prefix="cells-")
    with open(os.path.join(root, name), "w") as f:
        f.write("\n".join([HEADER, *lines]) + "\n")
    return root


@pytest.mark.parametrize("size", [512, 1 << 20])
def test_rows_are_those_of_the_file_whatever_its_splits(spark, size):
    lines, want = [], []
    for i in range(300):
        amount = "abc" if i % 7 == 0 else "5"
        when = "no date" if i % 11 == 0 else "NA" if i % 13 == 0 else "2025-01-02"
        lines.append(f"o{i},1,C,{when},{amount},2025-01-02 00:00:00")
        want += [(i, "return_date", "no date")] * (i % 11 == 0) + [(i, "total_actual_settlement", "abc")] * (i % 7 == 0)
    root = landed(lines)
    with settings(spark, {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}):
        rows, _ = CSV.scan_tolerant(spark, root)
        got = CL.cell_issues(rows, "returns", "default", RUN_TS, ("order_release_id",)).collect()
    assert sorted((r.row_index, r.column, r.value) for r in got) == sorted(want)
    assert all(r.order_release_id == f"o{r.row_index}" and r.severity == "warning" for r in got)
    assert {r.message for r in got} == {"Invalid date value: read as the run time", "Invalid float value: read as 0"}


def test_policies_and_values_that_are_no_mistake(spark):
    rows = spark.createDataFrame([("a", "1,000", "", "yes"), ("b", "12%", "NA", "No"), ("c", "9" * 30, "31/02/2025", "maybe"), (None, None, None, None)],
                                 "order_release_id string, final_amount string, created_on string, is_ship_rel string")
    rows = rows.selectExpr("*", "'f' AS _source_file", "struct('f' AS f, 0L AS b, monotonically_increasing_id() AS i) AS _ord")
    found = {p: sorted((r["column"], r["value"]) for r in CL.cell_issues(rows, "orders", p, RUN_TS).collect()) for p in ("default", "null", "repair")}
    assert ("final_amount", "9" * 30) in found["default"] and ("created_on", "31/02/2025") in found["default"]
    assert all(v in ("1,000", "12%", "9" * 30) for c, v in found["null"] if c == "final_amount")   # these policies read plain numbers
    assert ("is_ship_rel", "maybe") in found["default"]


def test_no_rows(spark):
    rows = spark.createDataFrame([], "order_release_id string, final_amount string, _source_file string, _ord struct<f:string,b:long,i:long>")
    assert CL.cell_issues(rows, "orders", "default", RUN_TS).collect() == []


def test_the_batch_run_reports_them(spark):
    issues = BT.ingest(spark, landed(["o0,1,C,2025-01-01,5,2025-01-02", "o1,1,C,never,x,2025-01-02"]), tempfile.mkdtemp(prefix="wh-"), RUN_TS)["issues"]
    got = [(r.row_index, r["column"], r.value) for r in issues.where("message LIKE 'Invalid %'").collect()]
    assert sorted(got) == [(1, "return_date", "never"), (1, "total_actual_settlement", "x")]
