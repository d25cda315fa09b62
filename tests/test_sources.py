"""Tolerant scan, repair read, routing on small hand-written files."""

import os
import tempfile

from settlekit.sources import csv as CSV


def _write(dirname, name, text):
    os.makedirs(dirname, exist_ok=True)
    with open(os.path.join(dirname, name), "w", encoding="utf-8") as f:
        f.write(text)


def test_tab_file_with_long_and_short_rows(spark):
    d = tempfile.mkdtemp(prefix="tab-")
    _write(d, "orders-03-2025.csv",
           " order release id \tbrand\tfinal amount\n"
           "1\tX\t10\n"
           "2\tY\t20\textra\n"      # long: skipped and reported
           "3\tZ\n"                 # short: kept, NULL padded
           "\t\t\n")                # all empty: dropped
    rows, bad = CSV.scan_tolerant(spark, d)
    got = sorted((r["order release id"], r["brand"], r["final amount"]) for r in rows.collect())
    assert got == [("1", "X", "10"), ("3", "Z", None)]
    assert bad.count() == 1


def test_comma_file_detected_from_header(spark):
    d = tempfile.mkdtemp(prefix="comma-")
    _write(d, "returns-03-2025.csv", 'order_release_id,return_type\n1,"a, b"\n2,exchange\n')
    rows, bad = CSV.scan_tolerant(spark, d)
    assert sorted(r.return_type for r in rows.collect()) == ["a, b", "exchange"]
    assert bad.count() == 0


def test_repair_read_joins_quoted_line_breaks(spark):
    d = tempfile.mkdtemp(prefix="repair-")
    _write(d, "orders.csv", 'id,note\n1,"line one\nline two, still"\n2,plain\n')
    got = sorted(tuple(r) for r in CSV.read_repaired(spark, d).collect())
    assert got == [("1", "line one line two, still"), ("2", "plain")]


def test_routing_and_period(spark):
    d = tempfile.mkdtemp(prefix="landing-")
    for n in ["orders-03-2025.csv", "returns-03-2025.csv", "settlement-04-2025.csv", "misc.csv"]:
        _write(d, n, "a\n1\n")
    got = {r.extract: (r.file_type, r.period) for r in CSV.list_landing(spark, d).collect()}
    assert got == {"orders-03-2025.csv": ("orders", "03-2025"), "returns-03-2025.csv": ("returns", "03-2025"),
                   "settlement-04-2025.csv": ("settlement", "04-2025"), "misc.csv": (None, "unknown")}
