"""Hand-computed and metamorphic cases of signals, grading, filings, intervals and quality."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.operators import asof, context, filings, forecast, ids, intervals, prices, quality, reconcile, scoreboard, signals

DAY = dt.date(2024, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


def walk(spark, n=90, names=4, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(day(i), i, s, float(rng.normal(0, 0.02)) if i else None, 20.0 + s, 1e6 * (s + 1)) for s in range(names) for i in range(n)]
    return spark.createDataFrame(rows, "date date, idx long, sid long, ret_cc double, close double, adv double")


@pytest.mark.parametrize("name", ["momentum", "reversal", "low_vol"])
def test_signals_do_not_look_ahead(spark, name):
    m = walk(spark)
    params = {"lookback": 40, "skip": 5} if name == "momentum" else {"lookback": 20}
    f = signals.create(signals.SIGNALS, name, **params)
    cut = 60
    poisoned = m.withColumn("ret_cc", F.when(F.col("idx") > cut, F.lit(9.0)).otherwise(F.col("ret_cc")))
    pick = lambda x: sorted(map(tuple, f(x).filter(F.col("date") == day(cut)).collect()))
    assert pick(m) == pick(poisoned) and pick(m)


def test_registry_rejects_duplicates_and_unknown():
    with pytest.raises(ValueError):
        signals.signal("momentum")(lambda: None)
    with pytest.raises(KeyError):
        signals.create(signals.SIGNALS, "nothing")


def test_momentum_ignores_the_skipped_month(spark):
    m = walk(spark, 60)
    jump = m.withColumn("ret_cc", F.when(F.col("idx") == 58, F.lit(3.0)).otherwise(F.col("ret_cc")))
    pick = lambda x: sorted(map(tuple, signals.momentum(x, 40, 5).filter(F.col("date") == day(59)).collect()))
    assert pick(m) == pick(jump)


def test_forward_returns_and_haircut(spark):
    rows = [(day(i), i, s, r) for s, rs in ((1, [None, 0.1, 0.1, 0.1]), (2, [None, 0.1])) for i, r in enumerate(rs)]
    m = spark.createDataFrame(rows, "date date, idx long, sid long, ret_cc double")
    lost = spark.createDataFrame([(2,)], "sid long")
    out = {(r.sid, r.idx): r.fwd for r in scoreboard.forward_returns(m, 2, lost=lost).collect()}
    assert out[1, 0] == pytest.approx(1.1**2 - 1) and out[2, 0] == pytest.approx(1.1 * 0.7 - 1) and out[1, 2] is None


def test_rank_ic_with_ties_matches_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"date": "a", "score": rng.integers(0, 5, 40).astype(float), "fwd": rng.normal(size=40)})
    got = scoreboard.rank_ic(spark.createDataFrame(pdf), ["date"]).first().ic
    assert got == pytest.approx(pdf["score"].rank().corr(pdf["fwd"].rank()))
    constant = spark.createDataFrame(pdf.assign(score=1.0))
    assert scoreboard.rank_ic(constant, ["date"]).count() == 0


def test_walk_forward_needs_six_months_and_ignores_later_targets(spark):
    rng = np.random.default_rng(5)
    rows = [(day(31 * m), s, float(x), float(0.01 + 0.02 * x)) for m in range(9) for s, x in enumerate(rng.normal(size=20))]
    t = spark.createDataFrame(rows, "date date, sid long, x double, actual double")
    run = lambda df: {(r.date, r.sid): r.forecast for r in forecast.walk_forward(df, ["x"]).collect()}
    a = run(t)
    assert all(a[day(31 * m), 0] is None for m in range(6))
    assert all(abs(a[d, s] - (0.01 + 0.02 * x)) < 1e-9 for d, s, x, _ in rows if d >= day(31 * 6))
    b = run(t.withColumn("actual", F.when(F.col("date") >= day(31 * 7), F.lit(5.0)).otherwise(F.col("actual"))))
    assert all(a[d, s] == b[d, s] for d, s, *_ in rows if d <= day(31 * 7))


def test_asof_strictness_tiebreak_and_age(spark):
    left = spark.createDataFrame([(1, day(10)), (1, day(11)), (1, day(700)), (2, day(5))], "k long, t date")
    right = spark.createDataFrame([(1, day(10), "a", 1), (1, day(10), "b", 2), (1, day(3), "c", 0)], "k long, r date, v string, tie long")
    run = lambda **kw: {(r.k, r.t): r.v for r in asof.asof_backward(left, right, ["k"], "t", "r", ["v"], tiebreak=["tie"], **kw).collect()}
    assert run() == {(1, day(10)): "b", (1, day(11)): "b", (1, day(700)): "b", (2, day(5)): None}
    assert run(strict=True, max_age_days=550) == {(1, day(10)): "c", (1, day(11)): "b", (1, day(700)): None, (2, day(5)): None}


def test_interval_lookup_rules(spark):
    names = spark.createDataFrame([(1, "A", day(0), day(9), True), (2, "A", day(10), None, True), (3, "A", day(0), None, False), (4, "B", day(0), None, False), (5, "B", day(0), None, False), (6, "C", day(0), None, False)], "sid long, ticker string, from date, to date, dated boolean")
    probes = spark.createDataFrame([("A", day(5)), ("A", day(20)), ("B", day(1)), ("C", day(1)), ("D", day(1))], "ticker string, date date")
    got = {(r.ticker, r.date): r.sid for r in intervals.lookup(names, probes).collect()}
    assert got == {("A", day(5)): 1, ("A", day(20)): 2, ("B", day(1)): None, ("C", day(1)): 6, ("D", day(1)): None}


def test_completeness_before_priority_and_handoff(spark):
    kind = "sid long, date date, total double, top double"
    a = spark.createDataFrame([(1, day(0), 1.0, None), (1, day(1), 1.0, 1.0), (2, day(0), 1.0, 1.0)], kind)
    b = spark.createDataFrame([(1, day(0), 2.0, 2.0), (1, day(2), 2.0, 2.0), (2, day(2), 2.0, 2.0), (3, day(0), 2.0, 2.0)], kind)
    got = {(r.sid, r.date): r.source for r in reconcile.reconcile({"sharadar": a, "alpaca": b}, ["sid", "date"], ["total", "top"]).collect()}
    assert got[1, day(0)] == "alpaca" and got[1, day(1)] == "sharadar"
    hand = {(r.sid, r.date) for r in reconcile.handoff({"sharadar": a, "alpaca": b}).collect()}
    assert hand == {(1, day(0)), (1, day(1)), (1, day(2)), (2, day(0)), (3, day(0))}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, 1), (2, 2)], "k long, v long")
    new = spark.createDataFrame([(2, 5), (2, 4), (3, 9)], "k long, v long")
    once = reconcile.upsert(old, new, ["k"], [F.desc("v")])
    twice = reconcile.upsert(once, new, ["k"], [F.desc("v")])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, 1), (2, 5), (3, 9)]


def test_judge_needs_history_and_flags_jumps(spark):
    values = [100 + k % 5 for k in range(20)] + [102, 106, 150]
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(values)], "k string, t long, value double")
    flags = [r.flag for r in quality.judge(df, ["k"], "t").orderBy("t").collect()]
    assert flags[:22] == [False] * 22 and flags[22]
    short = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 99.0)], "k string, t long, value double")
    assert not any(r.flag for r in quality.judge(short, ["k"], "t").collect())


FACT = "cik long, tag string, end date, value double, filed date, accn string, form string, start date"


def test_trailing_year_from_year_to_date_values(spark):
    y = dt.date
    spans = [(y(2020, 1, 1), y(2020, 3, 31), 10.0), (y(2020, 1, 1), y(2020, 6, 30), 25.0), (y(2020, 1, 1), y(2020, 9, 30), 45.0), (y(2020, 1, 1), y(2020, 12, 31), 70.0), (y(2021, 1, 1), y(2021, 3, 31), 20.0)]
    rows = [(1, "Revenues", e, v, e + dt.timedelta(days=40), str(i), "10-K" if i == 3 else "10-Q", s) for i, (s, e, v) in enumerate(spans)]
    out = {r.accn: r.revenue for r in filings.filing_states(spark.createDataFrame(rows, FACT)).collect()}
    assert out == {"0": None, "1": None, "2": None, "3": 70.0, "4": 80.0}


def test_tag_priority_balances_and_amendment(spark):
    end, start = dt.date(2020, 12, 31), dt.date(2020, 1, 1)
    rows = [(1, "ProfitLoss", end, 5.0, day(0), "a", "10-K", start), (1, "NetIncomeLoss", end, 7.0, day(0), "a", "10-K", start), (1, "Assets", dt.date(2020, 12, 28), 100.0, day(0), "a", "10-K", None), (1, "NetIncomeLoss", end, 3.0, day(9), "b", "10-K/A", start)]
    out = {r.accn: (r.net_income, r.assets) for r in filings.filing_states(spark.createDataFrame(rows, FACT)).collect()}
    assert out == {"a": (7.0, 100.0), "b": (3.0, 100.0)}


def test_long_last_quarter_and_share_counts(spark):
    y = dt.date
    spans = [(y(2020, 1, 1), y(2020, 3, 24), 10.0), (y(2020, 1, 1), y(2020, 6, 16), 21.0), (y(2020, 1, 1), y(2020, 9, 8), 33.0), (y(2020, 1, 1), y(2020, 12, 29), 50.0), (y(2020, 12, 30), y(2021, 3, 24), 13.0)]
    rows = [(1, "Revenues", e, v, e + dt.timedelta(days=40), str(i), "10-K" if i == 3 else "10-Q", s) for i, (s, e, v) in enumerate(spans)]
    shares = [(1, "WeightedAverageNumberOfSharesOutstandingBasic", e, 100.0 + i, e + dt.timedelta(days=40), str(i), "10-Q", s) for i, (s, e, _) in enumerate(spans[:2])]
    out = {r.accn: (r.revenue, r.shares_weighted) for r in filings.filing_states(spark.createDataFrame(rows + shares, FACT)).collect()}
    # The last quarter, of 16 weeks, is 50 - 33 = 17; a half year's average stands as reported.
    assert out["3"][0] == 50.0 and out["4"][0] == 53.0 and (out["0"][1], out["1"][1]) == (100.0, 101.0)


def test_restated_values_hold_from_their_filing_on(spark):
    ends = [dt.date(y, 12, 31) for y in (2018, 2019, 2020)]
    rows = [(1, "Revenues", e, 10.0 * (i + 1), e + dt.timedelta(days=50), f"{i}", "10-K", dt.date(e.year, 1, 1)) for i, e in enumerate(ends)]
    rows += [(1, "Revenues", ends[0], 11.0, ends[1] + dt.timedelta(days=50), "1", "10-K", dt.date(2018, 1, 1)), (1, "Revenues", None, 5.0, ends[0], "x", "10-K", None)]
    rows += [(1, "EntityCommonStockSharesOutstanding", ends[i] + dt.timedelta(days=30), 7.0 + i, ends[i] + dt.timedelta(days=50), f"{i}", "10-K", None) for i in (0, 1)]
    out = {r.accn: (r.revenue, r.prior_revenue, r.shares_out) for r in filings.filing_states(spark.createDataFrame(rows, FACT)).collect()}
    assert out == {"0": (10.0, None, 7.0), "1": (20.0, 11.0, 8.0), "2": (30.0, 20.0, 8.0)}
    assert filings.filing_states(spark.createDataFrame([], FACT)).count() == 0


def test_joins_by_blocks_against_all_pairs(spark):
    from tidewater.operators.asof import asof_nearest
    from tidewater.operators.intervals import in_any, shared_names
    from tidewater.operators.reconcile import later_product

    rng = np.random.default_rng(4)
    at = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=int(n))
    left = [(i, int(rng.integers(3)), at(rng.integers(-400, 900))) for i in range(120)] + [(120, None, at(0)), (121, 1, None)]
    right = [(int(rng.integers(3)), at(rng.integers(-400, 900)), j, float(rng.choice([0.0, 0.5, 2.0, 3.0]))) for j in range(80)]
    a, b = spark.createDataFrame(left, "i long, k int, d date"), spark.createDataFrame(right, "k int, e date, j long, f double")
    got = {r.i: r.j for r in asof_nearest(a, b, ["k"], "d", "e", ["j"], 9, tiebreak=["j"], row_key=["i"]).collect()}
    for i, k, d in left:
        near = [(-abs((e - d).days), e, j) for q, e, j, _ in right if d and q == k and abs((e - d).days) <= 9]
        assert got[i] == (max(near)[2] if near else None)
    got = {r.i: r.factor for r in later_product(a, b, "k", "d", "e", "f").collect()}
    assert got == {i: float(np.prod([f for q, e, _, f in right if d and q == k and e > d])) for i, k, d in left}
    spans = [(j, q, e, None if j % 9 == 0 else e + dt.timedelta(days=int(rng.integers(-5, 500)))) for j, (q, e, _, _) in enumerate(right)]
    s = spark.createDataFrame(spans, 'sid long, ticker int, "from" date, "to" date'.replace('"', "`"))
    got = {r.i: r.hit for r in in_any(a, s.withColumnRenamed("ticker", "k"), "k", "d", "hit").collect()}
    far = dt.date(2999, 12, 31)
    assert got == {i: any(d and q == k and f <= d <= (t or far) for _, q, f, t in spans) for i, k, d in left}
    whole = [(q, j, f, t or far) for j, q, f, t in spans if (t or far) >= f]
    want = {(q, j, m) for q, j, f, t in whole for p, m, g, u in whole if p == q and j < m and f <= u and g <= t}
    assert {tuple(r) for r in shared_names(s).collect()} == want


@pytest.mark.parametrize("inclusive", [False, True])
def test_expanding_percentile_against_all_pairs(spark, inclusive):
    from tidewater.functions.windows import expanding_percentile

    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(3)), t, None if t % 7 == 0 else float(rng.integers(8))) for t in range(150)]
    got = {r.t: r.pct for r in expanding_percentile(spark.createDataFrame(rows, "k int, t long, x double"), ["k"], "t", "x", 5, inclusive).collect()}
    for k, t, x in rows:
        past = [z for q, s, z in rows if q == k and s <= t and z is not None]
        share = None if x is None or len(past) < 5 else sum(z <= x if inclusive else z < x for z in past) / len(past)
        assert got[t] == share


def test_planted_beta_and_valuation(spark):
    rng = np.random.default_rng(2)
    oil, mkt = rng.normal(0, 0.02, 200), rng.normal(0, 0.01, 200)
    rows = [(1, float(2 * o + m), float(o), float(m)) for o, m in zip(oil, mkt)]
    got = {r.factor: r.beta for r in context.factor_betas(spark.createDataFrame(rows, "sid long, ret double, oil double, mkt double"), ["oil", "mkt"], ["sid"]).collect()}
    assert got["oil"] == pytest.approx(2.0, abs=0.05)
    v = spark.createDataFrame([(1, 900.0, 0.02, None), (1, 100.0, 0.20, 0.1)], "d long, mv double, ey double, by double")
    r = context.market_valuation(v, ["d"], "mv", ["ey", "by"]).first()
    assert r.ey == pytest.approx(0.038) and r.by == pytest.approx(0.1)


def test_eligibility_history_gate_and_floor(spark):
    rows = [(1, day(i), 4.0 if i < 6 else 6.0, 1e6) for i in range(8)]
    m = prices.liquidity(spark.createDataFrame(rows, "sid long, date date, close double, volume double"), window=3, least=2)
    got = [r.e for r in m.withColumn("e", prices.eligible(min_adv=1.0, min_bars=5)).orderBy("date").collect()]
    assert got == [False] * 6 + [True] * 2


def test_fade_and_sticky(spark):
    assert spark.range(1).select(signals.fade(F.lit(400), 300, 500).alias("x")).first().x == pytest.approx(0.5)
    ranks = spark.createDataFrame([(day(i), i, 1, r) for i, r in enumerate([399, 471, 500, 501, 450])], "date date, idx long, sid long, rank long")
    assert sorted(r.date for r in signals.sticky_sets(ranks, 400, 500).collect()) == [day(0), day(1), day(2)]


def test_merge_chain_and_extend(spark):
    r = ids.RESERVED
    names = spark.createDataFrame([(5, "A", day(0), day(9), True), (r, "A", day(5), day(20), True), (r + 1, "B", day(0), None, True), (r + 2, "B", day(3), None, True), (r, "B", day(50), None, True)], "sid long, ticker string, from date, to date, dated boolean")
    sec = spark.createDataFrame([(5, "x", "N", "common", day(0)), (r, "y", "N", "common", day(0))], "sid long, name string, exchange string, category string, first date")
    got = {(x.sid, x.into) for x in ids.merges(ids.Ids(sec, names)).collect()}
    assert got == {(r, 5), (r + 1, 5), (r + 2, 5)}
    new = spark.createDataFrame([("Z", "z", "N", "common", day(1)), ("C", "c", "N", "common", day(2))], "ticker string, name string, exchange string, category string, first date")
    out = ids.extend(ids.Ids(sec, names), new)
    assert {x.sid for x in out.securities.filter("name in ('c', 'z')").collect()} == {r + 1, r + 2}


def test_stress_gauge_history_and_tilt(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 0.5]
    df = spark.createDataFrame([(day(i), x, 2 * x) for i, x in enumerate(values)], "date date, a double, b double")
    got = [r.gauge for r in context.stress_gauge(df, ["a", "b"], 3).orderBy("date").collect()]
    assert got[:4] == [0.5] * 4 and got[4] == 1.0 and got[5] < 0.5
    assert spark.range(1).select(context.tilt(F.lit(0.7), 0.5, 0.9).alias("t")).first().t == pytest.approx(0.5)


def test_market_states(spark):
    def last(returns, fear=None):
        nav = np.cumprod(1 + np.array(returns))
        index = spark.createDataFrame([(day(i), i, float(x)) for i, x in enumerate(nav)], "date date, idx long, nav double")
        f = None if fear is None else spark.createDataFrame([(day(len(nav) - 3 + k), float(x)) for k, x in enumerate(fear)], "date date, fear double")
        return context.market_state(index, f).orderBy(F.desc("date")).first().state

    up, down = [0.001] * 600, [0.001] * 600 + [-0.003] * 120
    assert last(up) == "normal" and last(down) == "bear"
    assert last(down, [60, 50, 40]) == "rebound" and last(down, [40, 50, 60]) == "bear"
    assert last([0.001] * 600 + [-0.003] * 20) == "normal"


def test_environment_percentile_and_publication(spark):
    rows = [("x", day(i), day(i + 2), float(i % 7)) for i in range(40)]
    s = spark.createDataFrame(rows, "series string, date date, available date, value double")
    dates = spark.createDataFrame([(day(30),)], "date date")
    r = context.environment(dates, s, short=7, long=14, least=20).first()
    known = [float(i % 7) for i in range(29)]
    assert r.level == known[-1] and r.pct == pytest.approx(np.mean([k < known[-1] for k in known]))
    assert r.chg_short == known[-1] - float(21 % 7)


def test_prior_year_is_null_when_filed_later(spark):
    from tidewater.operators import features

    d = dt.date
    rows = [(1, d(2020, 12, 31), d(2021, 2, 1), 5.0), (1, d(2021, 12, 28), d(2022, 2, 1), 6.0), (2, d(2020, 12, 31), d(2023, 2, 1), 5.0), (2, d(2021, 12, 31), d(2022, 2, 1), 6.0)]
    s = spark.createDataFrame(rows, "sid long, period_end date, filed date, revenue double")
    got = {(r.sid, r.period_end): r.prior_revenue for r in features.with_prior(s, ["revenue"]).collect()}
    assert got[1, d(2021, 12, 28)] == 5.0 and got[2, d(2021, 12, 31)] is None and got[1, d(2020, 12, 31)] is None


def test_monthly_features_market_value_and_age(spark):
    from tidewater.operators import features

    cal = [day(i) for i in range(800)]
    m = spark.createDataFrame([(x, i, 1, 0.001 if i else None, 10.0, 1e6, True, i in (60, 700)) for i, x in enumerate(cal)], "date date, idx long, sid long, ret_cc double, close double, adv double, eligible boolean, month_end boolean")
    st = spark.createDataFrame([(1, day(50), day(20), 100.0, 50.0, 200.0)], "sid long, filed date, period_end date, shares_out double, net_income double, assets double")
    got = {r.date: r for r in features.monthly_features(m, st, window=40, month=5).collect()}
    a, b = got[day(60)], got[day(700)]
    assert a.market_value == pytest.approx(100 * 10 * 1.001**10) and a.roa == pytest.approx(0.25) and b.market_value is None


def test_fscore_from_years_perfect_and_missing_debt(spark):
    cols = {"net_income": (3, 1, 1), "cfo": (5, 1, 1), "assets": (10, 10, 10), "liab_cur": (1, 2, 2), "lt_debt": (None, 1, 1), "liabilities": (0, 5, 5), "shares": (9, 10, 10), "revenue": (12, 10, 10), "cost_of_revenue": (4, 5, 5), "assets_cur": (4, 4, 4), "gross_profit": (None, None, None)}
    names = [f"{c}_{t}" for c in cols for t in ("t", "t1", "t2")]
    row = tuple(None if x is None else float(x) for v in cols.values() for x in v)
    r = filings.fscores_from_years(spark.createDataFrame([row], ", ".join(f"{n} double" for n in names))).first()
    assert (r.fscore, r.n_signals, r.leverage) == (9, 9, 1)
    bank = tuple(None if n.startswith(("assets_cur", "cost_of")) else x for n, x in zip(names, row))
    r = filings.fscores_from_years(spark.createDataFrame([bank], ", ".join(f"{n} double" for n in names))).first()
    assert (r.fscore, r.n_signals, r.liquidity, r.margin) == (7, 7, None, None)


def test_shared_names_gives_pairs_of_many_spans_once_without_dealing_them_out(spark):
    from tidewater.operators.intervals import shared_names

    rng = np.random.default_rng(6)
    at = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=int(n))
    spans = [(int(s), int(q), at(f), at(f + n)) for s, q, f, n in zip(rng.integers(0, 25, 300), rng.integers(0, 4, 300), rng.integers(0, 1500, 300), rng.integers(-2, 90, 300))]
    spans += [(s, 9, at(k), at(k)) for s in (30, 31, 32) for k in range(0, 1000, s - 28)] + [(40, 8, at(0), None), (41, 8, at(900), None), (42, 8, at(5), at(4)), (None, 8, at(0), None)]
    out = shared_names(spark.createDataFrame(spans, "sid long, ticker int, `from` date, to date"))
    far = dt.date(2999, 12, 31)
    whole = [(q, s, f, t or far) for s, q, f, t in spans if s is not None and f <= (t or far)]
    want = {(q, s, m) for q, s, f, t in whole for p, m, g, u in whole if p == q and s < m and f <= u and g <= t}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "Aggregate [ticker" not in out._jdf.queryExecution().optimizedPlan().toString()  # no distinct of pairs


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_shared_names_keeps_open_spans_begun_after_the_far_day(spark, seed):
    from tidewater.operators.intervals import FAR, shared_names

    rng = np.random.default_rng(seed)
    far = dt.date.fromisoformat(FAR)
    near = lambda n: far + dt.timedelta(days=int(n))
    spans = [(1, 50, dt.date(2001, 1, 1), near(900)), (2, 50, near(400), None), (3, 50, near(901), None)]
    for q in range(60):
        for s, f, n in zip(rng.integers(0, 5, 9), rng.integers(-9, 12, 9), rng.integers(-2, 12, 9)):
            spans.append((int(s), int(q), near(f), None if rng.integers(3) == 0 else near(f + n)))
    got = [tuple(r) for r in shared_names(spark.createDataFrame(spans, "sid long, ticker int, `from` date, to date")).collect()]
    held = [(q, s, f, t or far) for s, q, f, t in spans if t is None or f <= t]
    want = {(q, s, m) for q, s, f, t in held for p, m, g, u in held if p == q and s < m and f <= u and g <= t}
    assert len(got) == len(set(got)) and set(got) == want and (50, 1, 2) in want


@pytest.mark.parametrize("chunk", [8, 4096])
def test_absorption_by_days_matches_the_correlation_matrix(spark, monkeypatch, chunk):
    monkeypatch.setattr(context, "NAMES", chunk)
    rng = np.random.default_rng(2)
    rows = []
    for g, names, days in (("wide", 60, 9), ("long", 12, 40), ("few", 5, 9), ("gone", 12, 1)):
        r = rng.normal(size=(days, 1)) + rng.normal(size=(days, names))
        r[:, 0] = 0.25  # does not move
        r[0, 1], r[: days // 2, 2] = np.nan, np.nan  # one day missing, and too many
        rows += [(g, s, day(k), None if np.isnan(r[k, s]) else float(r[k, s])) for s in range(names) for k in range(days)]
    rows += [("none", 1, day(0), None), ("wide", None, day(0), 3.0), (None, 1, day(0), 1.0)]
    got = {r.g: r.absorption for r in context.absorption(spark.createDataFrame(rows, "g string, sid long, date date, ret double"), ["g"]).collect()}
    assert got.keys() == {"wide", "long", "few", "gone", "none", None} and got["few"] is got["gone"] is got["none"] is got[None] is None
    for g in ("wide", "long"):
        m = pd.DataFrame([r[1:] for r in rows if r[0] == g and r[1] is not None], columns=["s", "d", "r"]).pivot_table(index="d", columns="s", values="r")
        m = m.dropna(axis=1, thresh=int(0.9 * len(m))).fillna(0.0)
        e = np.sort(np.linalg.eigvalsh(np.corrcoef(m.loc[:, m.max() > m.min()].to_numpy(), rowvar=False)))[::-1]
        assert got[g] == pytest.approx(e[: len(e) // 5].sum() / e.sum(), abs=1e-9)


def test_absorption_of_many_names_makes_no_matrix_of_names(spark):
    df = spark.range(20_000).selectExpr("1 AS g", "id AS sid", "explode(sequence(0, 4)) AS k").selectExpr("g", "sid", "date_add(date'2024-01-01', k) AS date", "sin(sid * 7 + k * k) AS ret")
    assert 0.9 < context.absorption(df, ["g"]).first().absorption <= 1.0 + 1e-9
