"""Sources, sinks, calendar and streams on small fixtures."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewater.operators import calendar, classify
from tidewater.sources import catalog, files, runs
from tidewater.streaming import streams

DAY = dt.date(2024, 1, 1)


def prices_of(spark, rows):
    return spark.createDataFrame([(s, d, c) for s, d, c in rows], "sid long, date date, close double")


def test_catalog_round_trip_upsert_and_span(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path))
    assert c.read("prices").count() == 0 and c.span("prices") == (None, None) and c.sources("prices") == []
    c.write("alpaca", "prices", prices_of(spark, [(1, dt.date(2023, 12, 29), 1.0), (1, DAY, 2.0)]))
    c.write("sharadar", "prices", prices_of(spark, [(1, dt.date(2023, 12, 29), 5.0)]))
    assert c.sources("prices") == ["alpaca", "sharadar"] and c.span("prices") == (dt.date(2023, 12, 29), DAY)
    assert [(r.date, r.close) for r in c.read("prices", ["close"]).collect()] == [(dt.date(2023, 12, 29), 5.0), (DAY, 2.0)]
    fix = prices_of(spark, [(1, DAY, 9.0), (2, DAY, 3.0)]).withColumn("arrival", F.lit(1))
    for _ in range(2):
        c.upsert("alpaca", "prices", fix, [F.desc("arrival"), "close"])
    got = {(r.sid, r.date): r.close for r in c.scan("alpaca", "prices").collect()}
    assert got == {(1, dt.date(2023, 12, 29)): 1.0, (1, DAY): 9.0, (2, DAY): 3.0}
    assert [r.sid for r in c.read("prices", ["close"], start=DAY, sids=spark.createDataFrame([(2,)], "sid long")).collect()] == [2]
    c.clear("alpaca", "prices")
    assert c.sources("prices") == ["sharadar"]


def test_directory_files_and_classes(spark, tmp_path):
    p = tmp_path / "listed.txt"
    p.write_text("Symbol|Security Name|Market Category|Test Issue|Financial Status|Round Lot Size|ETF|NextShares\nAAAA|Alpha Inc. - Common Stock|Q|N|N|100|N|N\nABCDW|Alpha Inc. - Warrant|Q|N|N|100|N|N\nFUND|Some ETF|G|N|N|100|Y|N\nTEST|Test Company|G|Y|N|100|N|N\nPBNK|Preferred Bank - Common Stock|Q|N|N|100|N|N\nFile Creation Time: 0101|||||||\n")
    got = {r.symbol: r.exclude_reason for r in classify.classify(files.nasdaq_listed(spark, str(p))).collect()}
    assert got == {"AAAA": None, "ABCDW": "warrant", "FUND": "etf", "TEST": "test", "PBNK": None}


def test_bars_payload_gives_new_york_days(spark):
    payload = json.dumps({"A": [{"t": "2024-01-02T05:00:00Z", "o": 1, "h": 2, "l": 1, "c": 2, "v": 10, "vw": 1.5, "n": 3}, {"t": "2024-01-03T03:00:00Z", "o": 9, "h": 9, "l": 9, "c": 9, "v": 1, "vw": 9, "n": 1}]})
    rows = files.bars(spark.createDataFrame([(payload,)], "json string")).collect()
    assert len(rows) == 1 and (rows[0].date, rows[0].close) == (dt.date(2024, 1, 2), 9.0)


def test_facts_keep_usual_periods(spark):
    unit = [{"end": "2020-12-31", "val": 5, "accn": "a", "form": "10-K", "filed": "2021-02-01", "start": "2020-01-01"}, {"end": "2020-12-31", "val": 1, "accn": "a", "form": "10-K", "filed": "2021-02-01", "start": "2020-09-01"}, {"end": "2020-12-31", "val": 7, "accn": "b", "form": "8-K", "filed": "2021-02-01", "start": "2020-01-01"}]
    payload = json.dumps({"cik": 7, "facts": {"us-gaap": {"Revenues": {"units": {"USD": unit}}, "Other": {"units": {"USD": unit}}}}})
    rows = files.facts(spark.createDataFrame([(payload,)], "json string"), ["Revenues"])
    assert [(r.cik, r.tag, r.value) for r in rows.collect()] == [(7, "Revenues", 5.0)] and files.annual(rows).count() == 1


def test_observations_rates_and_lists(spark):
    payload = json.dumps({"observations": [{"date": "2024-01-01", "value": "3.5", "realtime_start": "2024-02-10"}, {"date": "2024-01-02", "value": ".", "realtime_start": "2024-02-10"}]})
    df = spark.createDataFrame([("x", payload, 45, False), ("y", payload, 0, True)], "series string, json string, lag_days int, first_release boolean")
    assert {r.series: r.available for r in files.observations(df).collect()} == {"x": dt.date(2024, 2, 15), "y": dt.date(2024, 2, 10)}
    rates = spark.createDataFrame([("2024-01-02", "5.25"), ("2024-01-03", ".")], "DATE string, DTB3 string")
    assert [r.rate for r in files.rate_rows(rates, "DATE", "DTB3").collect()] == [0.0525]
    with pytest.raises(ValueError):
        files.rate_rows(rates, "DATE", "missing")
    lst = spark.createDataFrame([("brk-a", "NYSE", "Stock", "USD", "2000-01-01", "2010-01-01"), ("x", "NYSE", "Stock", "USD", None, "2010-01-01")], "ticker string, exchange string, assetType string, priceCurrency string, startDate string, endDate string")
    assert [r.symbol for r in files.ticker_list(lst).collect()] == ["BRK.A"]
    m = spark.createDataFrame([(json.dumps({"0": {"cik_str": 1, "ticker": "A-B"}, "1": {"cik_str": 2, "ticker": "A.B"}}),)], "json string")
    assert [(r.symbol, r.cik) for r in files.ticker_map(m).collect()] == [("A.B", 1)]


def test_zipped_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("t.csv", "ticker,close\nA,1.5\nB,\n")
    rows = files.zipped_csv(spark, str(tmp_path / "t.zip"), ["ticker", "close", "gone"]).collect()
    assert [(r.ticker, r.close, r.gone) for r in rows] == [("A", "1.5", None), ("B", None, None)]


def test_runs_are_complete_latest_and_pruned(spark, tmp_path):
    root = str(tmp_path)
    df = spark.range(3)
    at = dt.datetime(2024, 1, 1)
    ids_ = [runs.save_run(root, "m", {"settings": {"k": 1 if i < 3 else 1.0}}, {"daily": df}, at) for i in range(4)]
    assert len(set(ids_)) == 4 and len(runs.list_runs(root)) == 4 and len(runs.list_runs(root, latest=True)) == 1
    assert runs.load_run(spark, root, ids_[0], "daily").count() == 3
    assert len(runs.prune_runs(root, 2)) == 2 and len(runs.list_runs(root)) == 2
    (tmp_path / ids_[-1]).exists()
    runs.write_status(root + "/s.json", {"ok": True}, at)
    assert runs.read_status(root + "/s.json")["finished_at"].startswith("2024") and runs.read_status(root + "/none") is None


def test_calendar_helpers(spark):
    c = calendar.sessions(calendar.weekdays(spark, DAY, DAY + dt.timedelta(days=40), [dt.date(2024, 1, 15)]))
    rows = c.orderBy("date").collect()
    assert rows[0].date == DAY and [r.idx for r in rows] == list(range(len(rows)))
    assert [r.date.day for r in rows if r.week_end][:3] == [5, 12, 19] and [r.date.day for r in rows if r.month_end][0] == 31
    days = [r.date for r in rows]
    assert calendar.last_complete_session(days, dt.datetime(2024, 1, 3, 16, 10)) == dt.date(2024, 1, 2)
    assert calendar.freshness(days, dt.date(2024, 1, 2), dt.datetime(2024, 1, 3, 19)) == "late"
    assert calendar.freshness(days, dt.date(2024, 1, 3), dt.datetime(2024, 1, 3, 17)) == "current"


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("a", dt.datetime(2024, 1, 1, h), 0.01 * h) for h in range(3)] + [("b", dt.datetime(2024, 1, 9, 0), -0.5)]
    spark.createDataFrame(rows, "k string, ts timestamp, ret double").repartition(2).write.parquet(str(src))
    read = lambda: spark.readStream.schema("k string, ts timestamp, ret double").parquet(str(src))

    def finish(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    weeks = finish(streams.windowed(read(), "ts", ["k"], "ret", "1 week"), "complete", "weeks")
    assert {(r.start.date(), r.k, r.n) for r in weeks} == {(DAY, "a", 3), (dt.date(2024, 1, 8), "b", 1)}
    nav = {r.k: (r.n, r.nav, r.drawdown) for r in finish(streams.running_growth(read(), "k", "ts", "ret"), "update", "nav")}
    assert nav["a"] == (3, pytest.approx(1.01 * 1.02), 0.0) and nav["b"] == (1, 0.5, pytest.approx(-0.5))
    seen = []
    streams.upsert_stream(read(), lambda df, i: seen.append(df.count()), str(tmp_path / "up")).awaitTermination(120)
    assert sum(seen) == 4
