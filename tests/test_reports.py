"""Report tables on hand-computed cases."""

import datetime as dt

from pyspark.sql import functions as F

from tidewater.operators import report

D = [dt.date(2020, m, 1) for m in (1, 2, 3)]


def test_latest_holdings(spark):
    rows = [("a", D[0], 9, 1.0), ("a", D[1], 1, 0.5), ("a", D[1], 3, 0.2), ("a", D[1], 2, 0.2), ("a", D[2], 1, 0.0), ("b", D[0], 4, None)]
    got = report.latest_holdings(spark.createDataFrame(rows, "run string, date date, sid long, weight double"), top=2)
    assert sorted((r.run, r.date, r.sid, r.rank, r.positions) for r in got.collect()) == [("a", D[1], 1, 1, 3), ("a", D[1], 2, 2, 3)]
    assert report.latest_holdings(spark.createDataFrame([], "run string, date date, sid long, weight double")).count() == 0


def test_best_other(spark):
    rows = [("g", "x", 5.0, True), ("g", "z", 2.0, False), ("g", "y", 2.0, False), ("g", "n", None, False), ("g", "u", 9.0, None), ("h", "x", 1.0, True)]
    got = report.best_other(spark.createDataFrame(rows, "k string, name string, r double, mine boolean"), ["k"], "name", "r", F.col("mine"))
    assert [tuple(r) for r in got.collect()] == [("g", "y", 2.0)]


def test_densify_months(spark):
    rows = [("a", 1, D[0], 1.0), ("a", 1, D[0], 2.0), ("a", 2, D[2], 4.0), ("a", None, D[1], 7.0), ("b", 1, D[1], 5.0), ("b", 1, None, 6.0)]
    got = report.densify_months(spark.createDataFrame(rows, "run string, sid long, month date, w double"), "run", "sid", "month", "w")
    want = [("a", 1, D[0], 3.0), ("a", 1, D[1], 0.0), ("a", 1, D[2], 0.0), ("a", 2, D[0], 0.0), ("a", 2, D[1], 0.0), ("a", 2, D[2], 4.0), ("b", 1, D[1], 5.0)]
    assert sorted(map(tuple, got.collect())) == want
