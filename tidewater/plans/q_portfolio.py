"""Queries of portfolios, performance and tax."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import backtest, metrics, optimize, signals, tax
from tidewater.plans import views as v
from tidewater.plans.kit import r, registrar

QUERIES, ORACLE, query = registrar()


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS d, l_quantity * 100000 AS adv FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE WHEN d / adv <= 0.001 THEN 5 WHEN d / adv <= 0.01 THEN 10 WHEN d / adv <= 0.05 THEN 25 ELSE 55 END AS DOUBLE) AS bps FROM t""")
def cost_buckets(spark, sf):
    li = v.table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", backtest.cost_bps(F.col("l_extendedprice"), F.col("l_quantity") * 100000).alias("bps"))


def _market(spark, sf):
    m = v.market(spark, sf).withColumn("adv", F.col("close") * F.col("volume")).withColumn("traded", F.col("volume") > 0)
    return m.withColumn("ret_cc", F.when(F.abs("ret_cc") < 5, F.col("ret_cc") / 50)).withColumn("ret_co", F.lit(0.0))


def _rates(market):
    """A basis point a session on cash."""
    return market.select("date").distinct().withColumn("rf", F.lit(0.0001))


def _weights(market, runs: dict[str, int]):
    out = None
    for name, k in runs.items():
        w = signals.equal_weight(market.filter("month_end"), k).select(F.lit(name).alias("run"), "date", "sid", "weight")
        out = w if out is None else out.unionByName(w)
    return out


@query(None)
def backtest_costs(spark, sf):
    m = _market(spark, sf)
    return backtest.run_backtests(m, _weights(m, {"top5": 5, "top10": 10}))


@query(f"""WITH {v.MARKET}, p AS (SELECT idx, any_value(date) AS date, avg(CASE WHEN abs(ret_cc) < 5 THEN ret_cc / 50 END) AS ret FROM market GROUP BY 1)
SELECT date, round(exp(sum(ln(1 + coalesce(ret, 0))) OVER (ORDER BY idx)), 2) AS nav FROM p""")
def equal_weight_nav(spark, sf):
    p = _market(spark, sf).groupBy("idx").agg(F.min("date").alias("date"), F.avg("ret_cc").alias("ret"))
    w = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)  # one row a session
    return p.select("date", F.round(F.exp(F.sum(F.log1p(F.coalesce("ret", F.lit(0.0)))).over(w)), 2).alias("nav"))


@query(None)
def after_tax(spark, sf):
    """Trade logs of two runs replayed in a taxable account."""
    m = _market(spark, sf)
    weights = _weights(m, {"top5": 5, "top10": 10})
    log = backtest.run_backtests(m, weights, trades=True, rf=_rates(m))
    days = backtest.run_backtests(m, weights, rf=_rates(m))
    ends = days.groupBy("run").agg(F.max("date").alias("end"), F.max_by("nav", "date").alias("nav"))
    return tax.after_tax(log, ends)


@query(None)
def band_variants(spark, sf):
    """The same targets with a no-trade band: fewer trades."""
    m = _market(spark, sf)
    return backtest.run_backtests(m, _weights(m, {"top10": 10}), backtest.Settings(band=0.02))


def most_traded(m, top_n: int):
    """Rows of (year, sid, volume) of each year's ``top_n`` names by traded volume (ties by sid) among those of 12 months."""
    full = Window.partitionBy("year", "sid")
    m = m.withColumn("n", F.count("*").over(full)).filter("n = 12").withColumn("traded", F.sum("volume").over(full))
    return m.withColumn("k", F.dense_rank().over(Window.partitionBy("year").orderBy(F.desc("traded"), "sid"))).filter(F.col("k") <= top_n)


@query(None)
def optimizer_weights(spark, sf):
    """Least-volatility weights of each year's most traded names."""
    m = v.month_scores(spark, sf).filter("score is not null").withColumn("year", F.year("month"))
    pool = most_traded(m, 15)
    return optimize.optimized_weights(pool.select("year", "sid", F.col("month").alias("day"), F.col("score").alias("ret")), "min_volatility", by="year", cap=0.2, periods=12)


PERF = f"""WITH {v.INDEX}, n AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY key ORDER BY date)) AS nav FROM series_r), d AS (SELECT *, nav / greatest(max(nav) OVER (PARTITION BY key ORDER BY date), 1.0) - 1 AS dd FROM n)"""


@query(PERF + """ SELECT key, count(*) AS n, round(exp(sum(ln(1 + ret))) - 1, 5) AS total, round(exp(sum(ln(1 + ret)) * 252 / count(*)) - 1, 5) AS cagr, round(stddev_samp(ret) * sqrt(252), 5) AS vol, round(avg(ret) * sqrt(252) / stddev_samp(ret), 5) AS sharpe, round(avg(ret) * sqrt(252) / sqrt(avg(least(ret, 0) * least(ret, 0))), 5) AS sortino, round(min(dd), 5) AS max_drawdown FROM d GROUP BY key""")
def perf_metrics(spark, sf):
    p = metrics.performance(v.daily_index(spark, sf), "key")
    return p.select("key", "n", *[r(c, 5) for c in ("total", "cagr", "vol", "sharpe", "sortino", "max_drawdown")])


@query(f"""WITH {v.INDEX} SELECT key, CASE WHEN year(date) < 1997 THEN 'early' WHEN year(date) < 2000 THEN 'middle' ELSE 'late' END AS era, count(*) AS n, round(exp(sum(ln(1 + ret)) * 252 / count(*)) - 1, 5) AS cagr, round(stddev_samp(ret) * sqrt(252), 5) AS vol FROM series_r GROUP BY 1, 2""")
def scorecard_eras(spark, sf):
    era = F.when(F.year("date") < 1997, "early").when(F.year("date") < 2000, "middle").otherwise("late")
    return metrics.eras(v.daily_index(spark, sf), "key", era).select("key", "era", "n", r("cagr", 5), r("vol", 5))


@query(f"""WITH {v.INDEX}, y AS (SELECT year(a.date) AS year, sum(ln(1 + a.ret)) AS x, sum(ln(1 + b.ret)) AS y FROM series_r a JOIN series_r b ON a.date = b.date AND a.key = 'A' AND b.key = 'N' GROUP BY 1) SELECT count(*) FILTER (WHERE x > y) AS won, count(*) FILTER (WHERE x < y) AS lost FROM y""")
def years_won(spark, sf):
    d = v.daily_index(spark, sf)
    return metrics.years_won(d.filter("key = 'A'"), d.filter("key = 'N'"))


@query(f"""WITH {v.INDEX}, p AS (SELECT * FROM (VALUES ('full', DATE '1995-01-01', DATE '2002-01-01'), ('common', DATE '1997-01-01', DATE '1999-12-31')) t(name, first, last))
SELECT key, name, count(*) AS n, round(exp(sum(ln(1 + ret))) - 1, 5) AS total, round(stddev_samp(ret) * sqrt(252), 5) AS vol FROM series_r JOIN p ON date BETWEEN first AND last GROUP BY 1, 2""")
def fund_compare(spark, sf):
    periods = spark.createDataFrame([("full", "1995-01-01", "2002-01-01"), ("common", "1997-01-01", "1999-12-31")], "name string, first string, last string").select("name", F.to_date("first").alias("first"), F.to_date("last").alias("last"))
    out = metrics.compare_windows(v.daily_index(spark, sf), "key", periods)
    return out.select("key", "name", "n", r("total", 5), r("vol", 5))


@query(f"""WITH {v.INDEX}, n AS (SELECT key, date, round(exp(sum(ln(1 + ret)) OVER (PARTITION BY key ORDER BY date)), 9) AS nav FROM series_r), e AS (SELECT key, max(date) AS e, max_by(nav, date) AS last FROM n GROUP BY 1), g AS (SELECT key, e, last, y AS years FROM e CROSS JOIN (SELECT unnest([1, 3, 10]) AS y)),
 h AS (SELECT g.key, g.years, g.last, max_by(n.nav, n.date) AS t FROM g LEFT JOIN n ON g.key = n.key AND n.date <= g.e - CAST(round(g.years * 365.25) AS INTEGER) GROUP BY 1, 2, 3)
SELECT key, years, round(pow(last / t, 1.0 / years) - 1, 6) AS cagr FROM h""")
def horizons(spark, sf):
    w = Window.partitionBy("key").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = v.daily_index(spark, sf).withColumn("nav", F.round(F.exp(F.sum(F.log1p("ret")).over(w)), 9))
    return metrics.horizons(d, "key", [1, 3, 10]).select("key", "years", r("cagr"))


@query("""
WITH s AS (SELECT o_custkey AS key, CAST(o_orderdate AS DATE) AS date, o_orderkey, o_orderstatus AS v FROM orders),
u AS (SELECT key, date, max_by(v, o_orderkey) AS v FROM s GROUP BY 1, 2), l AS (SELECT key, max_by(v, date) AS v FROM u GROUP BY 1)
SELECT u.key, l.v AS state, min(u.date) AS since FROM u JOIN l ON u.key = l.key WHERE u.date > coalesce((SELECT max(x.date) FROM u x WHERE x.key = u.key AND x.v <> l.v), DATE '1900-01-01') GROUP BY 1, 2""")
def held_since(spark, sf):
    s = v.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("date")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("state"))
    return metrics.held_since(s, "key", "state")


@query(None)
def approx_after_tax(spark, sf):
    """Fast after-tax growth from monthly flows; tests hold it against the replay."""
    m = _market(spark, sf)
    weights = _weights(m, {"top5": 5, "top10": 10})
    log, days = backtest.run_backtests(m, weights, trades=True, rf=_rates(m)), backtest.run_backtests(m, weights, rf=_rates(m))
    return tax.approx_after_tax(tax.monthly_gains(log, days.select("run", "date", "nav")))


def _states(spark, sf):
    """Orders as a supplier's annual filings: a state a year, filed forty days after its end."""
    o = v.table(spark, sf, "orders")
    y = o.groupBy((F.col("o_custkey") % 100).alias("sid"), F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count("*").cast("double").alias("shares_out"))
    end = F.make_date("y", F.lit(12), F.lit(31))
    return y.select("sid", F.date_add(end, 40).alias("filed"), end.alias("period_end"), "revenue", "shares_out", (F.col("revenue") / 10).alias("net_income"), (F.col("revenue") * 2).alias("assets"))


@query(f"""WITH {v.MARKET}, st AS (SELECT o_custkey % 100 AS sid, make_date(year(o_orderdate), 12, 31) + 40 AS filed, round(sum(o_totalprice), 2) AS revenue, CAST(count(*) AS DOUBLE) AS shares FROM orders GROUP BY 1, year(o_orderdate)),
 px AS (SELECT sid, date, close, sum(ln(1 + coalesce(ret_cc, 0))) OVER (PARTITION BY sid ORDER BY date) AS l FROM market),
 val AS (SELECT st.*, px.close * st.shares AS fv, px.l AS fl FROM st ASOF LEFT JOIN px ON st.sid = px.sid AND st.filed >= px.date),
 g AS (SELECT m.date, m.sid, px.l FROM market m JOIN px ON m.sid = px.sid AND m.date = px.date WHERE m.month_end AND m.close > 500 AND m.volume > 0 AND m.idx >= 60)
SELECT g.date, g.sid, round(CASE WHEN date_diff('day', val.filed, g.date) <= 550 THEN fv * exp(g.l - fl) END + 1e-6, 2) AS market_value, round(CASE WHEN date_diff('day', val.filed, g.date) <= 550 AND fv * exp(g.l - fl) > 0 THEN revenue / (fv * exp(g.l - fl)) END, 6) AS sales_yield
FROM g ASOF LEFT JOIN val ON g.sid = val.sid AND g.date > val.filed""")
def monthly_features(spark, sf):
    from tidewater.operators import features

    m = v.market(spark, sf).withColumn("adv", F.col("close") * F.col("volume")).withColumn("eligible", (F.col("close") > 500) & (F.col("volume") > 0))
    out = features.monthly_features(m, _states(spark, sf), window=60, month=10)
    return out.select("date", "sid", F.round(F.col("market_value") + 1e-6, 2).alias("market_value"), r("sales_yield"))


@query(f"""WITH {v.BARS}, liq AS (SELECT *, CASE WHEN count(close * volume) OVER m >= 30 THEN median(close * volume) OVER m END AS adv, row_number() OVER (PARTITION BY sid ORDER BY date) AS bars_seen FROM bars WINDOW m AS (PARTITION BY sid ORDER BY date ROWS 59 PRECEDING)),
 l AS (SELECT s_suppkey AS sid, DATE '1996-01-01' AS f, CASE WHEN s_suppkey % 2 = 0 THEN DATE '1999-12-31' END AS t FROM supplier WHERE s_nationkey % 2 = 0)
SELECT liq.sid, liq.date, round(adv, 4) AS adv, bars_seen, volume > 0 AS traded, EXISTS (SELECT 1 FROM l WHERE l.sid = liq.sid AND liq.date >= f AND liq.date <= coalesce(t, DATE '2999-12-31')) AS common FROM liq""")
def daily_table(spark, sf):
    from tidewater.operators import features

    s = F.col("s_suppkey")
    listings = v.table(spark, sf, "supplier").select(s.alias("sid"), F.lit("1996-01-01").cast("date").alias("from"), F.when(s % 2 == 0, F.lit("1999-12-31").cast("date")).alias("to"), F.when(F.col("s_nationkey") % 2 == 0, "common").otherwise("fund").alias("category"))
    out = features.daily_table(v.bars(spark, sf), listings)
    return out.select("sid", "date", r("adv", 4), F.col("bars_seen").cast("long").alias("bars_seen"), "traded", "common")
