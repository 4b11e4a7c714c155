"""Vendor tables to shared tables, on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater.operators import conform, ids, optimize

DAY = dt.date(2024, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


@pytest.fixture()
def known(spark):
    sec = spark.createDataFrame([(1, "Old Co", "NYSE", "common", day(0), None), (2, "Dead", "NYSE", "adr", day(0), day(20))], "sid long, name string, exchange string, category string, first date, last date")
    names = spark.createDataFrame([(1, "OLD", day(0), day(9), True), (1, "NEW", day(10), None, True), (2, "DED", day(0), day(20), True)], "sid long, ticker string, from date, to date, dated boolean")
    return ids.Ids(sec, names)


def test_bars_resolve_number_and_keep_the_name_in_use(spark, known):
    rows = [("OLD", day(5), 1.0), ("NEW", day(5), 2.0), ("NEW", day(12), 3.0), ("OLD", day(12), 4.0), ("IPO", day(30), 5.0), ("GHO", day(1), 6.0)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double")
    symbols = spark.createDataFrame([("IPO", "Ipo Inc", "NASDAQ", "common")], "ticker string, name string, exchange string, category string")
    new, out = conform.bars_with_ids(known, bars, symbols, day(25))
    got = {(r.sid, r.date): (r.ticker, r.close) for r in out.collect()}
    # OLD's whole span is resolved by its first day, as nobody bears the name on its last.
    assert got == {(1, day(5)): ("OLD", 1.0), (1, day(12)): ("NEW", 3.0), (ids.RESERVED, day(30)): ("IPO", 5.0)}
    assert new.securities.count() == 3


def test_directory_listings(spark, known):
    rows = [("NEW", "Old Co", "NYSE", day(10), day(40), None), ("DED", "Dead", "NYSE", day(0), day(20), None), ("FRE", "Fresh", "NASDAQ", day(30), day(40), None), ("FREW", "Fresh Warrant", "NASDAQ", day(30), day(40), "warrant")]
    s = spark.createDataFrame(rows, "ticker string, name string, exchange string, first_seen date, last_seen date, exclude_reason string")
    new, out = conform.directory_listings(known, s)
    got = {r.sid: (r["from"], r["to"], r.category) for r in out.collect()}
    assert got == {1: (day(10), None, "common"), 2: (day(0), day(20), "adr"), ids.RESERVED: (day(30), None, "common")}


def test_delisting_actions(spark, known):
    dead = spark.createDataFrame([("DED", day(0), day(20), True), ("OLD", day(3), day(50), False), ("NON", day(0), day(1), False)], "ticker string, start date, end date, otc boolean")
    got = sorted((r.sid, r.date, r.action) for r in conform.delisting_actions(known, dead).collect())
    assert got == [(1, day(50), "delisted"), (2, day(20), "delisted"), (2, day(20), "otc")]


def test_split_restores_share_count_and_renamed_filing_counts_once(spark):
    rows = [(1, day(0), day(-30), "ART", "2023-Q4", "2024-03-01", day(60), 200.0), (1, day(0), day(-30), "ART", "2023-Q4", "2024-01-05", day(5), 100.0), (1, day(40), day(10), "ARQ", "2024-Q1", "2024-03-01", day(60), 200.0), (1, day(0), day(-30), "MRT", "2023-Q4", "2024-03-01", day(60), 1.0)]
    f = spark.createDataFrame(rows, "sid long, filed date, period_end date, dimension string, fiscalperiod string, lastupdated string, asof date, shares_out double")
    splits = spark.createDataFrame([(1, day(30), 2.0)], "sid long, date date, value double")
    got = {(r.filed, r.period, r.form): r.shares_out for r in conform.vendor_filings(f, splits).collect()}
    assert got == {(day(0), "ttm", "10-K"): 100.0, (day(40), "q", "10-Q"): 200.0}


def test_versions_maps_and_updates(spark, known):
    bulk = spark.createDataFrame([("A", day(0), 1.0, "2024-01-01", -1), ("A", day(1), 1.0, "2024-01-01", -1)], "ticker string, date date, close double, lastupdated string, pull int")
    up = spark.createDataFrame([("A", day(1), 2.0, "2024-01-02", 5), ("A", day(1), 3.0, "2024-01-02", 6)], "ticker string, date date, close double, lastupdated string, pull int")
    assert {(r.date, r.close) for r in conform.price_versions(bulk, up).collect()} == {(day(0), 1.0), (day(1), 3.0)}
    keys = spark.createDataFrame([("X", day(5)), ("X", day(1)), ("DED", day(5)), ("Y", day(5))], "ticker string, asof date")
    maps = spark.createDataFrame([("X", day(3), 7)], "ticker string, day date, sid long")
    today = spark.createDataFrame([("Y", 9)], "ticker string, sid long")
    assert {(r.ticker, r.asof): r.sid for r in conform.mapped_ids(keys, maps, today, known.names).collect()} == {("X", day(5)): 7, ("X", day(1)): None, ("DED", day(5)): 2, ("Y", day(5)): 9}


def test_incremental_update_equals_full(spark):
    kind = "sid long, date date, close double, open double, high double, low double, arrival int"
    rows = [(1, day(i), 10.0 + i, 10.0 + i, 11.0 + i, 9.0 + i, 0) for i in range(8)]
    sessions = spark.createDataFrame([(day(i),) for i in range(8)], "date date")
    nothing = spark.createDataFrame([], "sid long, date date, ret_cc double")
    full = conform.price_update(spark.createDataFrame(rows, kind), nothing, sessions)
    first = conform.price_update(spark.createDataFrame(rows[:5], kind), nothing, sessions)
    second = conform.price_update(spark.createDataFrame(rows[3:], kind), first, sessions)
    from tidewater.operators.reconcile import upsert

    both = upsert(first, second, ["sid", "date"], [F.desc("arrival")])
    pick = lambda df: sorted((r.date, r.close, r.ret_cc) for r in df.collect() if r.ret_cc is not None or r.date == day(0))
    assert pick(both) == pick(full)


def test_mean_variance_weights_and_blend(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(day(i), i, s, float(rng.normal(0.0005 * s, 0.01 * (1 + s / 4))), float(s)) for s in range(1, 9) for i in range(60)]
    m = spark.createDataFrame(rows, "date date, idx long, sid long, ret_cc double, adv double")
    w = {r.sid: r.weight for r in optimize.mean_variance(m, F.col("idx") == 59, top=6, lookback=40, objective="min_volatility", cap=0.4).collect()}
    assert set(w) <= set(range(3, 9)) and sum(w.values()) == pytest.approx(1) and max(w.values()) <= 0.4 + 1e-6
    poisoned = m.unionByName(spark.createDataFrame([(day(60), 60, s, 9.0, 1.0) for s in range(1, 9)], m.schema))
    again = {r.sid: r.weight for r in optimize.mean_variance(poisoned, F.col("idx") == 59, top=6, lookback=40, objective="min_volatility", cap=0.4).collect()}
    assert again == pytest.approx(w)
    one = spark.createDataFrame([(DAY, 1, 1.0)], "date date, sid long, weight double")
    two = spark.createDataFrame([(DAY, 2, 1.0)], "date date, sid long, weight double")
    tilt = spark.createDataFrame([(DAY, 0.25)], "date date, tilt double")
    assert {r.sid: r.weight for r in optimize.blend(one, two, tilt).collect()} == {1: 0.75, 2: 0.25}
