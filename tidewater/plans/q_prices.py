"""Queries of bars: scans, returns, liquidity, validation, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.scalars import conform
from tidewater.functions.windows import growth
from tidewater.operators import prices, quality
from tidewater.operators.calendar import rebalance_dates
from tidewater.operators.metrics import underwater, weekly_points
from tidewater.plans import views as v
from tidewater.plans.kit import off, r, registrar

QUERIES, ORACLE, query = registrar()


@query("SELECT event_id AS id, CAST(ts AS DATE) AS day, CAST(value AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS missing FROM events")
def scan_conform(spark, sf):
    e = v.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("day"), "value", "props")
    return conform(e, {"id": "bigint", "day": "date", "value": "double", "missing": "string"})


@query(f"WITH {v.BARS} SELECT sid, min(date) AS first, max(date) AS last, count(*) AS n FROM bars GROUP BY sid")
def table_span(spark, sf):
    return v.bars(spark, sf).groupBy("sid").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"))


@query(f"WITH {v.RETS} SELECT sid, date, round(close + 1e-9, 6) AS close, round(ret_cc + 1e-9, 6) AS ret_cc FROM rets")
def daily_returns(spark, sf):
    return v.rets(spark, sf).select("sid", "date", off("close"), off("ret_cc"))


@query("""
WITH d AS (SELECT l_suppkey AS sid, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS open, avg(l_extendedprice) AS close, avg(l_extendedprice) * (1 - avg(l_discount)) AS closeunadj, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)
SELECT sid, date, round(open * closeunadj / close + 1e-9, 6) AS open_raw, round(close * closeunadj / close + 1e-9, 6) AS close_raw, round(volume / (closeunadj / close) + 1e-9, 6) AS volume_raw,
  round(close / lag(close) OVER w - 1, 6) AS ret_cc, round(open / lag(close) OVER w - 1, 6) AS ret_co FROM d WHERE close > 0 WINDOW w AS (PARTITION BY sid ORDER BY date)""")
def split_adjust(spark, sf):
    d = v.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("sid"), F.to_date("l_shipdate").alias("date")).agg(F.max("l_extendedprice").alias("open"), F.avg("l_extendedprice").alias("close"), (F.avg("l_extendedprice") * (1 - F.avg("l_discount"))).alias("closeunadj"), F.sum("l_quantity").alias("volume"))
    d = d.withColumns({"high": F.col("open"), "low": F.col("close"), "closeadj": F.col("close")})
    return prices.undo_splits(d).select("sid", "date", off("open_raw"), off("close_raw"), off("volume_raw"), r("ret_cc"), r("ret_co"))


LIQ = v.RETS + """, liq AS (SELECT *, CASE WHEN count(close * volume) OVER m >= 30 THEN median(close * volume) OVER m END AS adv, row_number() OVER (PARTITION BY sid ORDER BY date) AS bars_seen
  FROM rets WINDOW m AS (PARTITION BY sid ORDER BY date ROWS 59 PRECEDING))"""


@query(f"WITH {LIQ} SELECT sid, date, round(adv, 4) AS adv, bars_seen FROM liq")
def adv_rolling_median(spark, sf):
    return prices.liquidity(v.bars(spark, sf)).select("sid", "date", r("adv", 4), F.col("bars_seen").cast("long").alias("bars_seen"))


@query(f"""WITH {LIQ} SELECT sid, date, coalesce(close > 1000 AND adv > 20000 AND bars_seen >= 100 AND volume > 0, FALSE) AS eligible FROM liq""")
def eligibility(spark, sf):
    m = prices.liquidity(v.bars(spark, sf)).withColumn("traded", F.col("volume") > 0)
    return m.select("sid", "date", prices.eligible(traded="traded", min_price=1000, min_adv=20000, min_bars=100).alias("eligible"))


@query("""
WITH raw AS (SELECT l_suppkey AS sid, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS close, l_extendedprice * (1 + l_tax) AS high, l_extendedprice * (1 - l_discount) * CASE WHEN l_orderkey % 50 = 0 THEN 2 ELSE 1 END AS low,
    l_discount * 100 - 1 AS ret_cc, l_orderkey * 10 + l_linenumber AS arrival, l_partkey FROM lineitem),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid, date ORDER BY arrival DESC, l_partkey DESC) AS n FROM raw) WHERE n = 1)
SELECT sid, date, round(close, 6) AS close, round(CASE WHEN ret_cc > -0.95 AND ret_cc < 10 THEN ret_cc END, 6) AS ret_cc FROM one
WHERE dayofweek(date) BETWEEN 1 AND 5 AND high * 1.000001 >= greatest(close, low) AND low <= least(close, high) * 1.000001 AND low > 0""")
def validate_rows(spark, sf):
    c = F.col
    raw = v.table(spark, sf, "lineitem").select(c("l_suppkey").alias("sid"), F.to_date("l_shipdate").alias("date"), c("l_extendedprice").alias("close"), c("l_extendedprice").alias("open"), (c("l_extendedprice") * (1 + c("l_tax"))).alias("high"), (c("l_extendedprice") * (1 - c("l_discount")) * F.when(c("l_orderkey") % 50 == 0, 2).otherwise(1)).alias("low"), (c("l_discount") * 100 - 1).alias("ret_cc"), F.struct((c("l_orderkey") * 10 + c("l_linenumber")).alias("a"), c("l_partkey")).alias("arrival"))
    sessions = v.cal(spark, sf).filter(F.dayofweek("date").between(2, 6)).select("date")
    return prices.validate(raw, sessions).select("sid", "date", r("close"), r("ret_cc"))


@query("""
SELECT 'price' AS "check", count(*) FILTER (WHERE l_extendedprice <= 1000) AS violations FROM lineitem
UNION ALL SELECT 'quantity', count(*) FILTER (WHERE l_quantity < 2) FROM lineitem
UNION ALL SELECT 'discount', count(*) FILTER (WHERE l_discount >= 0.1) FROM lineitem
UNION ALL SELECT 'duplicate_keys', count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem""")
def invariants(spark, sf):
    c = F.col
    return quality.invariants(v.table(spark, sf, "lineitem"), {"price": c("l_extendedprice") <= 1000, "quantity": c("l_quantity") < 2, "discount": c("l_discount") >= 0.1}, ["l_orderkey", "l_linenumber"])


@query("""
SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) AS n, round(avg(CASE WHEN l_extendedprice IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS coverage, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd,
 round(quantile_cont(l_extendedprice, 0.01), 4) AS q01, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75, round(quantile_cont(l_extendedprice, 0.99), 4) AS q99
FROM lineitem GROUP BY 1""")
def monthly_quality_stats(spark, sf):
    out = quality.monthly_stats(v.table(spark, sf, "lineitem"), F.trunc("l_shipdate", "month"), "l_extendedprice")
    return out.select("month", "n", r("coverage"), *[r(c, 4) for c in ("mean", "sd", "q01", "q25", "q50", "q75", "q99")])


@query("""
WITH m AS (SELECT l_returnflag AS stage, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY stage ORDER BY month)) AS step FROM m),
p AS (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi, max(step) OVER w AS most, count(value) OVER w AS past FROM s WINDOW w AS (PARTITION BY stage ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT stage, month, value, past, coalesce(past >= 12 AND (value > hi + most OR value < lo - most), FALSE) AS flag FROM p""")
def quality_judge(spark, sf):
    m = v.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("stage"), F.trunc("l_shipdate", "month").alias("month")).agg(F.count("*").cast("double").alias("value"))
    return quality.judge(m, ["stage"], "month").select("stage", "month", "value", "past", "flag")


@query(f"WITH {v.RETS} SELECT sid, date, round(exp(sum(ln(1 + coalesce(ret_cc, 0))) OVER (PARTITION BY sid ORDER BY date)), 6) AS growth FROM rets")
def cumulative_growth(spark, sf):
    return v.rets(spark, sf).select("sid", "date", F.round(growth("ret_cc", "sid", "date"), 6).alias("growth"))


@query(f"""WITH {v.INDEX}, n AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY key ORDER BY date)) AS nav FROM series_r),
d AS (SELECT *, nav / greatest(max(nav) OVER (PARTITION BY key ORDER BY date), 1.0) - 1 AS dd FROM n),
f AS (SELECT *, CASE WHEN (dd < 0) IS NOT DISTINCT FROM lag(dd < 0) OVER (PARTITION BY key ORDER BY date) THEN 0 ELSE 1 END AS ch FROM d),
i AS (SELECT *, sum(ch) OVER (PARTITION BY key ORDER BY date) AS island FROM f),
l AS (SELECT key, island, count(*) FILTER (WHERE dd < 0) AS len FROM i GROUP BY 1, 2)
SELECT d.key, round(min(dd), 6) AS max_drawdown, (SELECT max(len) FROM l WHERE l.key = d.key) AS longest FROM d GROUP BY d.key""")
def drawdown_underwater(spark, sf):
    d = underwater(v.daily_index(spark, sf), "key")
    runs = d.groupBy("key", "island").agg(F.count(F.when(F.col("drawdown") < 0, 1)).alias("len")).groupBy("key").agg(F.max("len").alias("longest"))
    return d.groupBy("key").agg(F.round(F.min("drawdown"), 6).alias("max_drawdown")).join(runs, "key")


@query("""
WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)
SELECT 'W' AS every, max(date) AS date FROM d GROUP BY isoyear(date), week(date)
UNION ALL SELECT 'M', max(date) FROM d GROUP BY year(date), month(date)
UNION ALL SELECT 'Q', max(date) FROM d GROUP BY year(date), quarter(date)""")
def rebalance_calendar(spark, sf):
    c = v.cal(spark, sf)
    parts = [rebalance_dates(c, e).select(F.lit(e).alias("every"), "date") for e in ("W", "M", "Q")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
WITH d AS (SELECT event_type AS key, CAST(ts AS DATE) AS date, round(sum(value), 6) AS nav FROM events GROUP BY 1, 2)
SELECT key, max(date) AS date, max_by(nav, date) AS nav FROM d GROUP BY key, date_trunc('week', date)
UNION SELECT key, min(date), min_by(nav, date) FROM d GROUP BY key""")
def weekly_last(spark, sf):
    d = v.table(spark, sf, "events").groupBy(F.col("event_type").alias("key"), F.to_date("ts").alias("date")).agg(F.round(F.sum("value"), 6).alias("nav"))
    return weekly_points(d, "key")


@query(f"""WITH {v.RETS}, f AS (SELECT sid, date, ret_cc + CASE WHEN sid % 10 = 0 AND day(date) = 7 THEN 0.01 ELSE 0 END AS fresh, ret_cc FROM rets)
SELECT sid, round(max(abs(ret_cc - fresh)), 6) AS worst FROM f GROUP BY sid HAVING max(abs(ret_cc - fresh)) > 0.0001""")
def return_drift(spark, sf):
    a = v.rets(spark, sf).select("sid", "date", "ret_cc")
    b = a.withColumn("ret_cc", F.col("ret_cc") + F.when((F.col("sid") % 10 == 0) & (F.dayofmonth("date") == 7), 0.01).otherwise(0.0))
    return prices.drift(a, b).select("sid", r("worst"))


@query("""
WITH x AS (SELECT o_custkey AS sid, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last FROM orders GROUP BY 1)
SELECT c_custkey AS sid, CASE WHEN last IS NULL THEN 'fresh' WHEN date_diff('day', last, DATE '2001-08-02') <= 20 THEN 'recent' ELSE 'stale' END AS plan FROM customer LEFT JOIN x ON c_custkey = sid""")
def fetch_plan(spark, sf):
    d = F.to_date("o_orderdate")
    extent = v.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("sid")).agg(F.min(d).alias("first"), F.max(d).alias("last"))
    return prices.plan_fetches(v.table(spark, sf, "customer").select(F.col("c_custkey").alias("sid")), extent, "2001-08-02").select("sid", "plan")


