"""Record borders found in parallel: the same records as a reader that sees the
whole file, whatever the blocks; stray quotes cost their own line only."""

import csv
import io
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from settlekit.session import settings
from settlekit.sources import csv as CSV
from settlekit.sources import records as R

NAMES = ["id", "brand", "note", "amount"]


def land(text, name="orders.csv", root=None):
    path = os.path.join(root or tempfile.mkdtemp(prefix="rec-"), name)
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(text)
    return path


def blocks(spark, size):
    """Files cut into small blocks (the tables read on the way are cut too)."""
    return settings(spark, {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"})


def read(spark, path, sep=","):
    raw, names = CSV.scan_raw(spark, path)
    rows, bad = CSV.split_raw(raw, names)
    got = [tuple(r) for r in rows.orderBy("_ord").select(*NAMES).collect()]
    return got, [(r.first_field, r.value) for r in CSV.stray_quotes(raw, names).collect()], bad.count()


def written(rows, sep, end):
    out = io.StringIO()
    w = csv.writer(out, delimiter=sep, lineterminator=end)
    w.writerow(NAMES)
    w.writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("seed,size,sep,end", [(1, 1100, ",", "\n"), (2, 2048, "\t", "\r\n"), (3, 1 << 20, ",", "\r\n")])
def test_random_quoted_files(spark, seed, size, sep, end):
    rng = random.Random(seed)
    pieces = ["a", '"', "\n", "\r\n", sep, " ", "é", "x y", '""', "5"]
    rows = [[str(i), "".join(rng.choice(pieces) for _ in range(rng.randint(1, 7))) + "z", "n" if i % 3 else "q" + rng.choice(pieces) + "w", str(i * 3)] for i in range(400)]
    path = land(written(rows, sep, end))
    with blocks(spark, size):
        got, stray, bad = read(spark, path)
    assert (got, stray, bad) == ([tuple(r) for r in rows], [], 0)


@pytest.mark.parametrize("sep,size", [(",", 1024), ("\t", 1 << 20)])
def test_one_unbalanced_quote_costs_nothing_but_its_line(spark, sep, size):
    lines = ["id,brand,note,amount", "1,ok,x,3", '2,"5 inch nail,x,5', '3,"ok",y,6', '4,"two\nlines, here",y,7', "5,a,b,8"]
    more = [str(i) for i in range(6, 300)]
    path = land("\n".join([*lines, *(f"{i},a,b,{i}" for i in more)]).replace(",", sep) + "\n")
    with blocks(spark, size):
        got, stray, bad = read(spark, path)
    assert got == [("1", "ok", "x", "3"), ("2", '"5 inch nail', "x", "5"), ("3", "ok", "y", "6"), ("4", f"two\nlines{sep} here", "y", "7"), ("5", "a", "b", "8"),
                   *((i, "a", "b", i) for i in more)]
    assert stray == [("2", lines[2].replace(",", sep))] and bad == 0


def test_stray_quotes_without_any_other_and_at_the_end(spark):
    got, stray, _ = read(spark, land('id,brand,note,amount\n1,"a,x,3\n2,b,x,4\n3,c,x,"5\n'))
    assert got == [("1", '"a', "x", "3"), ("2", "b", "x", "4"), ("3", "c", "x", '"5')] and len(stray) == 2


def test_a_record_with_too_many_fields_is_no_record(spark):
    """The next quote is followed by a delimiter, yet the rows between count."""
    got, stray, _ = read(spark, land('id,brand,note,amount\n1,"a,x,3\n2,b,x,4\n3,c"",x,5\n4,d",x,y,z,w,6\n'))
    assert [r[0] for r in got] == ["1", "2", "3"] and [s[0] for s in stray] == ["1"]


def test_short_and_long_records_beside_spanning_ones(spark):
    raw, names = CSV.scan_raw(spark, land('id,brand,note,amount\n1,"a\nb",x,3\n\n2,b\n3,c,"x",5,6\n4,"d\n,\n"\n'))
    rows, bad = CSV.split_raw(raw, names)
    assert [tuple(r)[:4] for r in rows.orderBy("_ord").collect()] == [("1", "a\nb", "x", "3"), ("2", "b", None, None), ("4", "d\n,\n", None, None)]
    assert [(r.message, r.value) for r in bad.collect()] == [("Skipping line: expected 4 fields, saw 5", '3,c,"x",5,6')]
    assert CSV.short_lines(raw, names).count() == 2


def test_only_files_with_open_lines_leave_the_csv_source(spark):
    root = tempfile.mkdtemp(prefix="rec-")
    land('id,brand,note,amount\n1,"a",x,3\n', "plain one.csv", root)
    land('id,brand,note,amount\n2,"b\nc",x,4\n', "spanning.csv", root)
    plain, spanning = R.files_by_quoting(spark, [root], ",")
    assert [p.rsplit("/", 1)[1] for p in plain] == ["plain one.csv"] and [p.rsplit("/", 1)[1] for p in spanning] == ["spanning.csv"]
    assert sorted(read(spark, root)[0]) == [("1", "a", "x", "3"), ("2", "b\nc", "x", "4")]
    os.remove(f"{root}/spanning.csv")
    assert R.files_by_quoting(spark, [root], ",") is None


def test_a_spanning_file_is_read_by_many_tasks(spark):
    rows = [[str(i), f"line {i}\nand more", "n", str(i)] for i in range(4000)]
    path = land(written(rows, ",", "\n"))
    with blocks(spark, 1 << 13):
        found = R.read_records(spark, [path], ",", 4)
        assert found.select("block").distinct().count() == -(-os.path.getsize(path) // (1 << 13))
        assert found.count() == 4000
        # no window sees a whole file's lines: they are by block, or over blocks
        raw, _ = CSV.scan_raw(spark, path)
        assert raw.agg(F.countDistinct("id")).first()[0] == 4000


def test_repaired_read_joins_lines_with_a_space(spark):
    path = land('id,brand,note,amount\r\n1,"a\r\nb",x,3\r\n2,c,"d\n\ne",4\r\n')
    with blocks(spark, 1 << 12):
        assert sorted(tuple(r) for r in CSV.read_repaired(spark, path).collect()) == [("1", "a b", "x", "3"), ("2", "c", "d  e", "4")]
