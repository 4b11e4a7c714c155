"""Queries of macro context, valuation, regimes and fundamentals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions.windows import expanding_percentile as expanding
from tidewater.operators import context, filings
from tidewater.plans import views as v
from tidewater.plans.kit import r, registrar

QUERIES, ORACLE, query = registrar()


@query(f"""WITH {v.SERIES}, s AS (SELECT series, date, round(value, 6) AS value FROM series)
SELECT a.series, a.date, CASE WHEN count(*) >= 5 THEN round(count(*) FILTER (WHERE b.value < a.value) / CAST(count(*) AS DOUBLE), 6) END AS pct FROM s a JOIN s b ON a.series = b.series AND b.date <= a.date GROUP BY 1, 2, a.value""")
def expanding_percentile(spark, sf):
    s = v.series(spark, sf).withColumn("value", F.round("value", 6))
    return expanding(s, ["series"], "date", "value", 5).select("series", "date", r("pct"))


ENV = """s AS (SELECT series, date, available, round(value, 6) AS value FROM series), days AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events), g AS (SELECT date, series FROM days CROSS JOIN (SELECT DISTINCT series FROM series)),
 l AS (SELECT g.date, g.series, s.value AS level FROM g ASOF LEFT JOIN s ON g.series = s.series AND g.date >= s.available),
 a AS (SELECT g.date, g.series, s.value AS a FROM g ASOF LEFT JOIN s ON g.series = s.series AND g.date - 7 >= s.available),
 b AS (SELECT g.date, g.series, s.value AS b FROM g ASOF LEFT JOIN s ON g.series = s.series AND g.date - 14 >= s.available)"""


@query(f"""WITH {v.SERIES}, {ENV} SELECT date, series, round(level, 6) AS level, round(CASE WHEN series = 'click' THEN ln(level / a) ELSE level - a END, 5) AS chg_short, round(CASE WHEN series = 'click' THEN ln(level / b) ELSE level - b END, 5) AS chg_long, round(pct, 6) AS pct
FROM l JOIN a USING (date, series) JOIN b USING (date, series) JOIN (SELECT g.date, g.series, CASE WHEN count(*) >= 5 THEN count(*) FILTER (WHERE s.value < l2.level) / CAST(count(*) AS DOUBLE) END AS pct FROM g JOIN l l2 USING (date, series) LEFT JOIN s ON g.series = s.series AND s.available <= g.date GROUP BY 1, 2) USING (date, series)""")
def environment_changes(spark, sf):
    e = v.table(spark, sf, "events").select(F.to_date("ts").alias("date")).distinct()
    s = v.series(spark, sf).withColumn("value", F.round("value", 6))
    out = context.environment(e, s, {"click": "log"}, 7, 14, 5)
    return out.select("date", "series", r("level"), r("chg_short", 5), r("chg_long", 5), r("pct"))


@query("""SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, round(sum(l_discount * l_extendedprice) / sum(l_extendedprice), 6) AS disc, round(sum(CASE WHEN l_tax > 0.02 THEN l_tax * l_extendedprice END) / sum(CASE WHEN l_tax > 0.02 THEN l_extendedprice END), 6) AS tax FROM lineitem GROUP BY 1""")
def market_valuation(spark, sf):
    li = v.table(spark, sf, "lineitem").select(F.trunc("l_shipdate", "month").alias("month"), F.col("l_discount").alias("disc"), F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("tax"), F.col("l_extendedprice").alias("mv"))
    return context.market_valuation(li, ["month"], "mv", ["disc", "tax"]).select("month", r("disc"), r("tax"))


MONTHLY = v.SCORES + ", x AS (SELECT month, sid, score AS ret, avg(score) OVER (PARTITION BY month) AS market FROM scores WHERE score IS NOT NULL)"


@query(f"WITH {MONTHLY} SELECT sid, round(regr_slope(ret, market), 5) AS beta, CAST(regr_count(ret, market) AS BIGINT) AS n FROM x GROUP BY sid")
def factor_betas(spark, sf):
    m = v.month_scores(spark, sf).filter("score is not null").select("month", "sid", F.col("score").alias("ret"), F.avg("score").over(Window.partitionBy("month")).alias("market"))
    return context.simple_beta(m, ["sid"]).select("sid", r("beta", 5), "n")


@query(f"WITH {MONTHLY} SELECT sid, 'market' AS factor, round(regr_slope(ret, market), 5) AS beta FROM x GROUP BY sid")
def factor_betas_grouped(spark, sf):
    m = v.month_scores(spark, sf).filter("score is not null").select("sid", F.col("score").alias("ret"), F.avg("score").over(Window.partitionBy("month")).alias("market"))
    return context.factor_betas(m, ["market"], ["sid"]).select("sid", "factor", r("beta", 5))


@query(f"""WITH {v.INDEX}, n AS (SELECT key, date, row_number() OVER (PARTITION BY key ORDER BY date) AS idx, round(exp(sum(ln(1 + ret)) OVER (PARTITION BY key ORDER BY date)), 9) AS nav FROM series_r), o AS (SELECT * FROM n WHERE key = 'A'),
 a AS (SELECT date, idx, nav, CASE WHEN count(nav) OVER p = 50 THEN nav < round(avg(nav) OVER p, 9) END AS below, 1 - nav / max(nav) OVER (ORDER BY idx ROWS 125 PRECEDING) AS down FROM o WINDOW p AS (ORDER BY idx ROWS 49 PRECEDING))
SELECT date, CASE WHEN coalesce(idx >= 60 AND below AND lag(below, 5) OVER (ORDER BY idx) AND lag(below, 10) OVER (ORDER BY idx) AND down >= 0.05, FALSE) THEN 'bear' ELSE 'normal' END AS state FROM a""")
def regime_flags(spark, sf):
    w = Window.partitionBy("key").orderBy("date")
    d = v.daily_index(spark, sf).filter("key = 'A'").withColumn("idx", F.row_number().over(w))
    d = d.withColumn("nav", F.round(F.exp(F.sum(F.log1p("ret")).over(w.rowsBetween(Window.unboundedPreceding, 0))), 9))
    return context.market_state(d, average=50, step=5, bear=0.05, high=126, history=60)


@query(f"""WITH {v.FILINGS}, y AS (SELECT sid, year(filed) AS year, sum(amount) AS amount, count(*) AS n FROM filings GROUP BY 1, 2)
SELECT a.sid, a.year, round(a.amount / a.n, 4) AS mean, round(CASE WHEN b.amount > 0 THEN a.amount / b.amount END, 6) AS growth, round(CASE WHEN c.amount > 0 THEN b.amount / c.amount END, 6) AS growth_before FROM y a LEFT JOIN y b ON a.sid = b.sid AND a.year = b.year + 1 LEFT JOIN y c ON a.sid = c.sid AND a.year = c.year + 2""")
def filing_ratios(spark, sf):
    from tidewater.functions.scalars import ratio

    y = v.filings(spark, sf).groupBy("sid", F.year("filed").cast("long").alias("year")).agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))
    p = filings.annual_pairs(y, "sid", "year", ["amount", "n"])
    return p.select("sid", "year", F.round(ratio("amount_t", "n_t"), 4).alias("mean"), F.round(ratio("amount_t", "amount_t1"), 6).alias("growth"), F.round(ratio("amount_t1", "amount_t2"), 6).alias("growth_before"))


BRANDS = """li AS (SELECT p_brand AS brand, year(l_shipdate) AS year, l_quantity AS q, l_extendedprice AS e, l_discount AS d, l_tax AS t FROM lineitem JOIN part ON l_partkey = p_partkey),
 y AS (SELECT brand, year, round(sum(e * (1 - d) - q * 900), 2) AS ni, round(sum(e * (0.9 - t) - q * 800), 2) AS cfo, round(sum(e), 2) AS assets, round(sum(q), 2) AS liab, round(sum(e * t), 2) AS debt, CAST(count(*) AS DOUBLE) AS shares, round(sum(e), 2) AS rev, round(sum(q * 850), 2) AS cost, round(sum(e * (1 - t)), 2) AS cur FROM li GROUP BY 1, 2)"""


@query(f"""WITH {BRANDS}, p AS (SELECT a.*, b.ni AS ni1, b.assets AS a1, b.liab AS l1, b.debt AS d1, b.shares AS s1, b.rev AS r1, b.cost AS c1, b.cur AS u1, c.assets AS a2 FROM y a LEFT JOIN y b ON a.brand = b.brand AND a.year = b.year + 1 LEFT JOIN y c ON a.brand = c.brand AND a.year = c.year + 2),
 s AS (SELECT brand, year, ni / a1 > 0 AS x1, cfo > 0 AS x2, ni / a1 > ni1 / a2 AS x3, cfo / a1 > ni / a1 AS x4, debt / ((assets + a1) / 2) < d1 / ((a1 + a2) / 2) OR (debt = 0 AND d1 = 0 AND a2 IS NOT NULL) AS x5, cur / liab > u1 / l1 AS x6, shares <= s1 AS x7, (rev - cost) / rev > (r1 - c1) / r1 AS x8, rev / a1 > r1 / a2 AS x9 FROM p)
SELECT brand, year, CAST(coalesce(x1::INT, 0) + coalesce(x2::INT, 0) + coalesce(x3::INT, 0) + coalesce(x4::INT, 0) + coalesce(x5::INT, 0) + coalesce(x6::INT, 0) + coalesce(x7::INT, 0) + coalesce(x8::INT, 0) + coalesce(x9::INT, 0) AS INTEGER) AS fscore,
 CAST((x1 IS NOT NULL)::INT + (x2 IS NOT NULL)::INT + (x3 IS NOT NULL)::INT + (x4 IS NOT NULL)::INT + (x5 IS NOT NULL)::INT + (x6 IS NOT NULL)::INT + (x7 IS NOT NULL)::INT + (x8 IS NOT NULL)::INT + (x9 IS NOT NULL)::INT AS INTEGER) AS n_signals FROM s""")
def fscore_signals(spark, sf):
    c = F.col
    li = v.table(spark, sf, "lineitem").join(v.table(spark, sf, "part").select("p_partkey", c("p_brand").alias("brand")), c("l_partkey") == c("p_partkey"))
    q, e, d, t = (c(f"l_{x}") for x in ("quantity", "extendedprice", "discount", "tax"))
    total = lambda x, n: F.round(F.sum(x), 2).alias(n)
    y = li.groupBy("brand", F.year("l_shipdate").cast("long").alias("year")).agg(total(e * (1 - d) - q * 900, "net_income"), total(e * (0.9 - t) - q * 800, "cfo"), total(e, "assets"), total(q, "liab_cur"), total(e * t, "lt_debt"), F.count("*").cast("double").alias("shares"), total(e, "revenue"), total(q * 850, "cost_of_revenue"), total(e * (1 - t), "assets_cur"))
    y = y.withColumns({"gross_profit": F.lit(None).cast("double"), "liabilities": F.lit(None).cast("double")})
    names = ["net_income", "cfo", "assets", "liab_cur", "lt_debt", "shares", "revenue", "cost_of_revenue", "assets_cur", "gross_profit", "liabilities"]
    return filings.fscores_from_years(filings.annual_pairs(y, "brand", "year", names)).select("brand", "year", "fscore", "n_signals")


@query("""
WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders),
q AS (SELECT o_custkey AS cik, year(d) * 4 + quarter(d) AS k, CAST(min(o_orderkey) AS VARCHAR) AS accn, sum(o_totalprice) AS x, last_day(CAST(max(date_trunc('quarter', d)) + INTERVAL 2 MONTH AS DATE)) AS e FROM o GROUP BY 1, 2),
t AS (SELECT *, CASE WHEN count(*) OVER w = 4 THEN sum(x) OVER w END AS y FROM q WINDOW w AS (PARTITION BY cik ORDER BY k RANGE BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT a.cik, a.accn, a.e + 40 AS filed, a.e AS period_end, round(a.y, 2) AS revenue, round(b.y, 2) AS prior_revenue FROM t a LEFT JOIN t b ON a.cik = b.cik AND b.k = a.k - 4""")
def filing_states(spark, sf):
    """Orders as quarterly revenue facts of a customer."""
    o = v.table(spark, sf, "orders")
    end = F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2))
    facts = o.groupBy(F.col("o_custkey").alias("cik"), end.alias("end")).agg(F.sum("o_totalprice").alias("value"), F.min("o_orderkey").cast("string").alias("accn"))
    facts = facts.select("cik", F.lit("Revenues").alias("tag"), "end", "value", F.date_add("end", 40).alias("filed"), "accn", F.lit("10-Q").alias("form"), F.trunc("end", "quarter").alias("start"))
    return filings.filing_states(facts).select("cik", "accn", "filed", "period_end", r("revenue", 2), r("prior_revenue", 2))


@query(None)
def absorption(spark, sf):
    m = v.month_scores(spark, sf).filter("score is not null").select(F.year("month").alias("year"), "sid", F.col("month").alias("date"), F.col("score").alias("ret"))
    return context.absorption(m, ["year"])


@query(f"""WITH {v.SERIES}, d AS (SELECT date, round(avg(value), 6) AS a, round(max(value), 6) AS b FROM series GROUP BY 1), p AS (SELECT x.date, (count(*) FILTER (WHERE y.a <= x.a) / CAST(count(*) AS DOUBLE) + count(*) FILTER (WHERE y.b <= x.b) / CAST(count(*) AS DOUBLE)) / 2 AS m FROM d x JOIN d y ON y.date <= x.date GROUP BY x.date HAVING count(*) >= 5),
 g AS (SELECT x.date, CASE WHEN count(*) >= 5 THEN count(*) FILTER (WHERE y.m <= x.m) / CAST(count(*) AS DOUBLE) END AS gauge FROM p x JOIN p y ON y.date <= x.date GROUP BY x.date, x.m)
SELECT d.date, round(coalesce(gauge, 0.5), 6) AS gauge FROM d LEFT JOIN g USING (date)""")
def stress_gauge(spark, sf):
    d = v.series(spark, sf).groupBy("date").agg(F.round(F.avg("value"), 6).alias("a"), F.round(F.max("value"), 6).alias("b"))
    return context.stress_gauge(d, ["a", "b"], 5).select("date", r("gauge"))


@query(f"""WITH {v.INDEX}, w AS (SELECT key, date, list(ret) OVER x AS l, count(ret) OVER x AS n, stddev_pop(ret) OVER x AS vol, sum(ln(1 + ret)) OVER x AS g FROM series_r WINDOW x AS (PARTITION BY key ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING))
SELECT key, date, round(CASE WHEN n = 21 THEN exp(g) - 1 END, 6) AS fwd_ret, round(CASE WHEN n = 21 THEN vol END, 6) AS fwd_vol FROM w""")
def forward_stats(spark, sf):
    return context.forward_stats(v.daily_index(spark, sf), 21).select("key", "date", r("fwd_ret"), r("fwd_vol"))


@query(f"""WITH {v.INDEX}, w AS (SELECT key, date, ret, stddev_pop(ret) OVER x AS vol, sum(ln(1 + ret)) OVER x AS g, count(ret) OVER x AS n FROM series_r WHERE key = 'A' WINDOW x AS (PARTITION BY key ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING))
SELECT 'day' AS condition, CASE WHEN ret < -0.01 THEN 'down' WHEN ret < 0.01 THEN 'flat' ELSE 'up' END AS bucket, count(*) AS n, round(avg(exp(g) - 1), 6) AS ret, round(avg(vol), 6) AS vol FROM w WHERE n = 21 GROUP BY 2""")
def caution_dial(spark, sf):
    from tidewater.operators.scoreboard import caution_dial as dial

    d = v.daily_index(spark, sf).filter("key = 'A'")
    out = dial(d.select("date", "ret"), context.forward_stats(d, 21).drop("key"), {"day": (F.col("ret"), [-0.01, 0.01], ["down", "flat", "up"])})
    return out.select("condition", "bucket", "n", r("ret"), r("vol"))
