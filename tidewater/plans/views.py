"""Views of the driver's tables in the shapes that the operators take, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.scalars import ieee


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark, sf) -> DataFrame:
    """Suppliers' ship days as daily bars: (sid, date, close, volume, high, low)."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("sid"), F.to_date("l_shipdate").alias("date")).agg(
        ieee(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"), F.max(price).alias("high"), F.min(price).alias("low")
    )


BARS = """bars AS (SELECT l_suppkey AS sid, CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS close,
  CAST(sum(l_quantity) AS DOUBLE) AS volume, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low
  FROM lineitem GROUP BY 1, 2)"""


def rets(spark, sf) -> DataFrame:
    """Bars with ret_cc."""
    from tidewater.operators.prices import daily_returns

    return daily_returns(bars(spark, sf))


RETS = BARS + """, rets AS (SELECT *, CASE WHEN lag(close) OVER w > 0 THEN close / lag(close) OVER w - 1 END AS ret_cc
  FROM bars WINDOW w AS (PARTITION BY sid ORDER BY date))"""


def cal(spark, sf) -> DataFrame:
    from tidewater.operators.calendar import sessions

    return sessions(table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")))


CAL = """cal AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS BIGINT) AS idx,
  date = max(date) OVER (PARTITION BY date_trunc('month', date)) AS month_end FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem))"""


def market(spark, sf) -> DataFrame:
    """Returns with the session index; the calendar has a row a day and is broadcast."""
    c = cal(spark, sf).select("date", F.col("idx").cast("long").alias("idx"), "month_end")
    return rets(spark, sf).join(F.broadcast(c), "date")


MARKET = RETS + ", " + CAL + ", market AS (SELECT r.*, c.idx, c.month_end FROM rets r JOIN cal c USING (date))"


def month_scores(spark, sf) -> DataFrame:
    """(month, sid, score, fwd): score is the month's growth, fwd the next month's."""
    from pyspark.sql import Window

    known = F.when(F.col("close").isNotNull(), F.col("date"))  # SQL's max_by passes over null closes
    m = rets(spark, sf).groupBy("sid", F.trunc("date", "month").alias("month")).agg(F.max_by("close", known).alias("close"), F.sum("volume").alias("volume"))
    w = Window.partitionBy("sid").orderBy("month")
    return m.select("month", "sid", "volume", (ieee(F.col("close"), F.lag("close").over(w)) - 1).alias("score"), (F.lead("close").over(w) / F.col("close") - 1).alias("fwd"))


SCORES = BARS + """, months AS (SELECT sid, CAST(date_trunc('month', date) AS DATE) AS month, max_by(close, date) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2),
 scores AS (SELECT month, sid, volume, close / lag(close) OVER w - 1 AS score, lead(close) OVER w / close - 1 AS fwd FROM months WINDOW w AS (PARTITION BY sid ORDER BY month))"""


def filings(spark, sf) -> DataFrame:
    """Orders as filings: (sid, accn, filed, period_end, amount, form)."""
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("sid"), F.col("o_orderkey").alias("accn"), d.alias("filed"), F.date_sub(d, 40).alias("period_end"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("form"))


FILINGS = """filings AS (SELECT o_custkey AS sid, o_orderkey AS accn, CAST(o_orderdate AS DATE) AS filed, CAST(o_orderdate AS DATE) - 40 AS period_end,
  o_totalprice AS amount, o_orderstatus AS form FROM orders)"""


def series(spark, sf) -> DataFrame:
    """Event types' daily mean values: (series, date, available, value), known a day later."""
    d = F.to_date("ts")
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("series"), d.alias("date")).agg(F.avg("value").alias("value")).withColumn("available", F.date_add("date", 1))


SERIES = "series AS (SELECT event_type AS series, CAST(ts AS DATE) AS date, avg(value) AS value, CAST(ts AS DATE) + 1 AS available FROM events GROUP BY 1, 2, 4)"


def daily_index(spark, sf) -> DataFrame:
    """(key, date, ret): each ship mode of returns' daily revenue as a damped return series; key is the return flag."""
    from pyspark.sql import Window

    d = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("key"), F.to_date("l_shipdate").alias("date")).agg(F.avg("l_extendedprice").alias("v"))
    before = F.lag("v").over(Window.partitionBy("key").orderBy("date"))
    return d.select("key", "date", ((F.col("v") - before) / (F.col("v") + before) / 10).alias("ret")).filter("ret is not null")


INDEX = """daily AS (SELECT l_returnflag AS key, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2),
 idx AS (SELECT key, date, (v - lag(v) OVER w) / (v + lag(v) OVER w) / 10 AS ret FROM daily WINDOW w AS (PARTITION BY key ORDER BY date)),
 series_r AS (SELECT * FROM idx WHERE ret IS NOT NULL)"""


def user_days(spark, sf) -> DataFrame:
    """(sid, date, n, total, top): events of a user and day."""
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("sid"), F.to_date("ts").alias("date")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.max("value").alias("top"))


def sources(spark, sf) -> dict[str, DataFrame]:
    """Two overlapping copies of the users' days: one lacks ``top`` for odd users, the other ends early for every third user."""
    d = user_days(spark, sf)
    a = d.filter("pmod(sid + day(date), 5) <> 0").select("sid", "date", "total", F.when(F.col("sid") % 2 == 0, F.col("top")).alias("top"))
    b = d.filter("pmod(sid, 7) <> 0 and (pmod(sid, 3) <> 0 or date < '2024-01-20')").select("sid", "date", (F.col("total") + 1).alias("total"), "top")
    return {"sharadar": a, "alpaca": b}


SOURCES = """user_days AS (SELECT user_id AS sid, CAST(ts AS DATE) AS date, round(sum(value), 6) AS total, max(value) AS top FROM events GROUP BY 1, 2),
 src AS (SELECT 'sharadar' AS source, 0 AS rank, sid, date, total, CASE WHEN sid % 2 = 0 THEN top END AS top FROM user_days WHERE (sid + day(date)) % 5 <> 0
   UNION ALL SELECT 'alpaca', 1, sid, date, total + 1, top FROM user_days WHERE sid % 7 <> 0 AND (sid % 3 <> 0 OR date < DATE '2024-01-20'))"""


def episodes(spark, sf) -> DataFrame:
    """Orders as names with spans: (sid, ticker, from, to, dated); the ticker is a coarse key shared by customers."""
    from pyspark.sql import Window

    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("sid"), F.to_date("o_orderdate").alias("from"), "o_orderkey", (F.col("o_orderstatus") != "P").alias("dated"))
    w = Window.partitionBy("sid").orderBy("from", "o_orderkey")
    e = o.withColumn("to", F.date_sub(F.lead("from").over(w), 1)).filter("to is null or `from` <= to")
    return e.select("sid", (F.col("sid") % 97).alias("ticker"), "from", "to", "dated", "o_orderkey")


EPISODES = """episodes AS (SELECT * FROM (SELECT o_custkey AS sid, o_custkey % 97 AS ticker, CAST(o_orderdate AS DATE) AS "from",
  CAST(lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS DATE) AS "to", o_orderstatus <> 'P' AS dated, o_orderkey FROM orders)
  WHERE "to" IS NULL OR "from" <= "to")"""
