"""Queries of signals, grading and selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions.windows import avg_rank, pct_rank, pct_rank_mid
from tidewater.operators import forecast, prices, scoreboard, signals
from tidewater.plans import views as v
from tidewater.plans.kit import r, registrar, signed

QUERIES, ORACLE, query = registrar()

LG = "ln(1 + coalesce(ret_cc, 0))"


@query(f"""WITH {v.MARKET}, m AS (SELECT sid, date, idx, sum({LG}) OVER (PARTITION BY sid ORDER BY idx RANGE BETWEEN 59 PRECEDING AND 5 PRECEDING) AS g,
 count(*) OVER (PARTITION BY sid ORDER BY idx RANGE BETWEEN 60 PRECEDING AND 60 PRECEDING) AS s FROM market)
SELECT date, sid, round(exp(coalesce(g, 0)) - 1, 6) AS score FROM m WHERE s > 0""")
def momentum_12_1(spark, sf):
    return signals.momentum(v.market(spark, sf), 60, 5).select("date", "sid", r("score"))


@query(f"""WITH {v.MARKET}, liq AS (SELECT *, CASE WHEN count(close * volume) OVER w >= 10 THEN median(close * volume) OVER w END AS adv FROM market WINDOW w AS (PARTITION BY sid ORDER BY date ROWS 19 PRECEDING)),
 m AS (SELECT sid, date, sum({LG}) OVER (PARTITION BY sid ORDER BY idx RANGE BETWEEN 59 PRECEDING AND 5 PRECEDING) AS g, count(*) OVER (PARTITION BY sid ORDER BY idx RANGE BETWEEN 60 PRECEDING AND 60 PRECEDING) AS s FROM market),
 pool AS (SELECT date, sid FROM (SELECT date, sid, row_number() OVER (PARTITION BY date ORDER BY adv DESC, sid) AS n FROM liq WHERE month_end AND adv IS NOT NULL) WHERE n <= 20),
 best AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, sid) AS n FROM (SELECT p.date, p.sid, round(exp(coalesce(m.g, 0)) - 1, 9) AS score FROM pool p JOIN m ON p.date = m.date AND p.sid = m.sid WHERE m.s > 0))
SELECT date, sid, round(score, 6) AS score, round(1.0 / count(*) OVER (PARTITION BY date), 6) AS weight FROM best WHERE n <= 5""")
def momentum_portfolio(spark, sf):
    m = prices.liquidity(v.market(spark, sf), window=20, least=10)
    scored = signals.momentum(m, 60, 5).withColumn("score", F.round("score", 9))
    pool = signals.top_liquid(m.filter("month_end"), 20).select("date", "sid")
    return signals.top_equal(pool.join(scored, ["date", "sid"]), 5).select("date", "sid", r("score"), r("weight"))


@query(f"""WITH {v.MARKET}, m AS (SELECT *, coalesce(ret_cc, 0) AS r0, avg(ret_cc) OVER (PARTITION BY idx) AS mk FROM market),
 f AS (SELECT date, sid, count(ret_cc) OVER w AS n, stddev_pop(ret_cc) OVER w AS vol, covar_pop(r0, mk) OVER w AS cv, var_pop(mk) OVER w AS vm, sum(ln(1 + r0)) OVER (PARTITION BY sid ORDER BY idx RANGE BETWEEN 9 PRECEDING AND CURRENT ROW) AS g1, sum(ln(1 + r0)) OVER (PARTITION BY sid ORDER BY idx RANGE BETWEEN 59 PRECEDING AND 10 PRECEDING) AS g12
  FROM m WINDOW w AS (PARTITION BY sid ORDER BY idx RANGE BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT date, sid, round(CASE WHEN n >= 12 THEN exp(coalesce(g12, 0)) - 1 END, 5) AS mom12, round(CASE WHEN n >= 12 THEN exp(g1) - 1 END, 5) AS mom1, round(CASE WHEN n >= 12 THEN vol END, 5) AS vol, round(CASE WHEN n >= 12 AND vm <> 0 THEN cv / vm END, 4) AS beta FROM f""")
def volatility_beta(spark, sf):
    out = signals.price_features(v.market(spark, sf), 60, 10, 0.2)
    return out.select("date", "sid", r("mom12", 5), r("mom1", 5), r("vol", 5), r("beta", 4))


@query(f"""WITH {v.RETS}, m AS (SELECT sid, CAST(date_trunc('month', date) AS DATE) AS month, sum({LG}) AS g FROM rets GROUP BY 1, 2),
 w AS (SELECT sid, month, count(g) OVER x AS n, sum(g) OVER x AS s FROM (SELECT *, year(month) * 12 + month(month) AS k FROM m) WINDOW x AS (PARTITION BY sid ORDER BY k RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT month, sid, round(CASE WHEN n = 5 THEN exp(s) - 1 END, 6) AS mom6m FROM w""")
def mom6m_calendar(spark, sf):
    return signals.calendar_month_momentum(v.rets(spark, sf)).select("month", "sid", r("mom6m"))


@query(f"""WITH {v.MARKET}, e AS (SELECT max(idx) AS e FROM market), l AS (SELECT sid, max(idx) AS l FROM market GROUP BY 1),
 f AS (SELECT date, idx, sid, sum({LG}) OVER (PARTITION BY sid ORDER BY idx RANGE BETWEEN 1 FOLLOWING AND 21 FOLLOWING) AS g FROM market)
SELECT date, f.sid, round(CASE WHEN f.idx + 21 <= e THEN exp(coalesce(g, 0)) * CASE WHEN f.sid % 4 = 0 AND l < e AND l < f.idx + 21 THEN 0.7 ELSE 1.0 END - 1 END, 6) AS fwd FROM f JOIN l ON f.sid = l.sid CROSS JOIN e""")
def forward_returns(spark, sf):
    m = v.market(spark, sf)
    lost = m.filter("sid % 4 = 0").select("sid").distinct()
    return scoreboard.forward_returns(m, 21, lost=lost).select("date", "sid", r("fwd"))


KNOWN = v.SCORES + ", known AS (SELECT month, sid, score, fwd FROM scores WHERE score IS NOT NULL AND fwd IS NOT NULL)"
IC = KNOWN + """, ranked AS (SELECT *, rank() OVER (PARTITION BY month ORDER BY score) + (count(*) OVER (PARTITION BY month, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY month ORDER BY fwd) + (count(*) OVER (PARTITION BY month, fwd) - 1) / 2.0 AS b FROM known),
 ics AS (SELECT month, count(*) AS n, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS ic FROM ranked GROUP BY 1 HAVING count(*) >= 5 AND stddev_pop(a) * stddev_pop(b) <> 0)"""


@query(f"WITH {IC} SELECT month, n, round(ic, 6) AS ic FROM ics")
def rank_ic(spark, sf):
    return scoreboard.rank_ic(v.month_scores(spark, sf), ["month"], least=5).select("month", "n", r("ic"))


@query(f"""WITH {KNOWN}, e AS (SELECT month, quantile_cont(score, 0.8) AS hi, quantile_cont(score, 0.2) AS lo FROM known GROUP BY 1 HAVING count(*) >= 5 AND max(score) > min(score))
SELECT month, round(avg(fwd) FILTER (WHERE score >= hi), 6) AS top, round(avg(fwd) FILTER (WHERE score <= lo), 6) AS bottom FROM known JOIN e USING (month) GROUP BY 1""")
def quintile_spread(spark, sf):
    return scoreboard.quantile_spread(v.month_scores(spark, sf), ["month"], least=5).select("month", r("top"), r("bottom"))


@query(f"""WITH {KNOWN}, p AS (SELECT *, count(*) OVER (PARTITION BY month) AS n, row_number() OVER (PARTITION BY month ORDER BY score, sid) AS k FROM known)
SELECT month, count(*) AS n, round(avg(fwd) FILTER (WHERE k > n - greatest(n // 10, 1)) - avg(fwd) FILTER (WHERE k <= greatest(n // 10, 1)), 6) AS spread FROM p GROUP BY month""")
def decile_spread(spark, sf):
    return scoreboard.decile_spread(v.month_scores(spark, sf), ["month"], "sid").select("month", "n", r("spread"))


@query(f"""WITH {KNOWN}, p AS (SELECT *, count(*) OVER (PARTITION BY month) AS n, row_number() OVER (PARTITION BY month ORDER BY score, sid) AS k FROM known), b AS (SELECT *, CAST(floor(k * 20 / (n + 1)) AS BIGINT) AS bin FROM p),
 mm AS (SELECT bin, 1.645 * stddev_samp(m) / sqrt(count(*)) AS margin FROM (SELECT bin, month, avg(fwd) AS m FROM b GROUP BY 1, 2) GROUP BY 1)
SELECT b.bin, count(*) AS n, round(avg(fwd), 6) AS mean, round(quantile_cont(fwd, 0.25), 6) AS q25, round(quantile_cont(fwd, 0.75), 6) AS q75, round(any_value(mm.margin), 6) AS margin FROM b JOIN mm ON b.bin = mm.bin GROUP BY 1""")
def fit_bins(spark, sf):
    return scoreboard.fit_bins(v.month_scores(spark, sf), ["month"], "sid").select("bin", "n", r("mean"), r("q25"), r("q75"), r("margin"))


@query(f"""WITH {KNOWN}, h AS (SELECT quantile_cont(CAST(date_diff('day', DATE '1970-01-01', month) AS DOUBLE), 0.5) AS mid FROM known), k AS (SELECT *, date_diff('day', DATE '1970-01-01', month) <= mid AS first FROM known CROSS JOIN h)
SELECT count(*) AS n, round(regr_slope(fwd, score), 6) AS slope, round(regr_slope(fwd, score) FILTER (WHERE first), 6) AS slope_first, round(regr_slope(fwd, score) FILTER (WHERE NOT first), 6) AS slope_second, round(1 - avg((fwd - score) * (fwd - score)) / avg(fwd * fwd), 6) AS r2 FROM k""")
def grade_report(spark, sf):
    out = scoreboard.grade_report(v.month_scores(spark, sf).withColumnRenamed("month", "date"))
    return out.select("n", *[r(c) for c in ("slope", "slope_first", "slope_second", "r2")])


@query(f"""WITH {IC} SELECT year(month) AS year, count(ic) AS n, round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS sd, round(avg(ic) * sqrt(count(ic)) / nullif(stddev_samp(ic), 0), 4) AS t, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END), 6) AS hit FROM ics GROUP BY 1""")
def ic_summary(spark, sf):
    ics = scoreboard.rank_ic(v.month_scores(spark, sf), ["month"], least=5).withColumn("year", F.year("month").cast("long"))
    return scoreboard.summarize(ics, ["year"], F.lit(12)).select("year", "n", r("mean"), r("sd"), r("t", 4), r("hit"))


@query(f"""WITH {IC}, l AS (SELECT ic, 'size' AS condition, CASE WHEN n < 60 THEN 'few' WHEN n < 90 THEN 'some' ELSE 'many' END AS bucket FROM ics UNION ALL SELECT ic, 'season', CASE WHEN month(month) < 5 THEN 'early' WHEN month(month) < 9 THEN 'middle' ELSE 'late' END FROM ics)
SELECT condition, bucket, count(ic) AS n, round(avg(ic), 6) AS mean, round(avg(ic) * sqrt(count(ic)) / nullif(stddev_samp(ic), 0), 4) AS t FROM l GROUP BY 1, 2""")
def conditional_ic(spark, sf):
    ics = scoreboard.rank_ic(v.month_scores(spark, sf), ["month"], least=5)
    cond = {"size": (F.col("n"), [60, 90], ["few", "some", "many"]), "season": (F.month("month"), [5, 9], ["early", "middle", "late"])}
    return scoreboard.conditional_ic(ics, cond).select("condition", "bucket", "n", r("mean"), r("t", 4))


@query(f"""WITH {v.SCORES}, s AS (SELECT m.month, m.sid, m.score, s.s_nationkey % 5 AS sic2 FROM scores m JOIN supplier s ON m.sid = s.s_suppkey)
SELECT month, sid, round(CASE WHEN count(*) OVER g >= 5 AND score IS NOT NULL THEN (rank() OVER (PARTITION BY month, sic2, score IS NULL ORDER BY score) + (count(*) OVER (PARTITION BY month, sic2, score) - 1) / 2.0) / count(score) OVER g END, 6) AS ind FROM s WINDOW g AS (PARTITION BY month, sic2)""")
def industry_pct_rank(spark, sf):
    i = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sid"), (F.col("s_nationkey") % 5).alias("sic2"))
    m = v.month_scores(spark, sf).join(F.broadcast(i), "sid")
    return m.select("month", "sid", F.round(pct_rank("score", ["month", "sic2"], 5), 6).alias("ind"))


@query(f"""WITH {v.SCORES}, p AS (SELECT month, sid, score, rank() OVER (PARTITION BY month, score IS NULL ORDER BY score) + (count(*) OVER (PARTITION BY month, score) - 1) / 2.0 AS k FROM scores)
SELECT month, sid, round(CASE WHEN score IS NOT NULL THEN (k - 0.5) / count(score) OVER (PARTITION BY month) END, 6) AS pct, round(CASE WHEN score IS NOT NULL THEN k / count(*) OVER (PARTITION BY month) - 0.5 END, 6) AS size FROM p""")
def month_pct_rank(spark, sf):
    m = v.month_scores(spark, sf)
    size = avg_rank("score", ["month"]) / F.count("*").over(Window.partitionBy("month")) - 0.5
    return m.select("month", "sid", F.round(pct_rank_mid("score", ["month"]), 6).alias("pct"), F.round(size, 6).alias("size"))


@query(f"""WITH {v.SCORES}, a AS (SELECT month, sid, asinh((score - avg(score) OVER w) / stddev_samp(score) OVER w) AS s FROM scores WINDOW w AS (PARTITION BY month)), q AS (SELECT month, quantile_cont(s, 0.01) AS lo, quantile_cont(s, 0.99) AS hi FROM a GROUP BY 1),
 c AS (SELECT a.month, sid, CASE WHEN s IS NOT NULL THEN greatest(least(s, hi), lo) END AS s FROM a JOIN q USING (month))
SELECT month, sid, round(coalesce((s - avg(s) OVER w) / nullif(stddev_samp(s) OVER w, 0), 0), 5) AS score FROM c WINDOW w AS (PARTITION BY month)""")
def standardize_asinh(spark, sf):
    out = forecast.scaled(v.month_scores(spark, sf).filter("month is not null").select("month", "sid", "score"), ["score"], "month")
    return out.select("month", "sid", signed("score", 5))


@query(f"""WITH {v.BARS}, t AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY volume DESC, sid) AS n FROM bars)
SELECT date, sid, volume, round(1.0 / count(*) OVER (PARTITION BY date), 6) AS weight FROM t WHERE n <= 5""")
def top_liquid(spark, sf):
    best = signals.top_liquid(v.bars(spark, sf), 5, "volume")
    return best.select("date", "sid", "volume", F.round(1.0 / F.count("*").over(Window.partitionBy("date")), 6).alias("weight"))


@query(f"""WITH {v.SCORES}, t AS (SELECT month, sid, row_number() OVER (PARTITION BY month ORDER BY score NULLS FIRST, sid) / CAST(count(*) OVER (PARTITION BY month) AS DOUBLE) AS s FROM scores)
SELECT month, sid, CASE WHEN s > 0.9 THEN 'top' WHEN s <= 0.1 THEN 'bottom' END AS tenth FROM t""")
def tenth_membership(spark, sf):
    return scoreboard.tenths(v.month_scores(spark, sf), ["month"], "sid").select("month", "sid", "tenth")


@query(f"""WITH {v.SCORES}, l AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY volume DESC NULLS LAST, sid) AS liq FROM scores WHERE score IS NOT NULL), p AS (SELECT unnest([20, 30, 40]) AS pool), t AS (SELECT unnest([5, 10]) AS top),
 k AS (SELECT pool, month, sid, row_number() OVER (PARTITION BY pool, month ORDER BY score DESC, sid) AS n FROM l JOIN p ON liq <= pool)
SELECT month, sid, round(count(*) / 6.0, 6) AS share FROM k JOIN t ON n <= top GROUP BY 1, 2""")
def soft_selection(spark, sf):
    m = v.month_scores(spark, sf).filter("score is not null").withColumnRenamed("month", "date")
    return signals.soft_weights(m, [20, 30, 40], [5, 10], "volume").select(F.col("date").alias("month"), "sid", r("share"))


@query(f"""WITH {v.SCORES}, t AS (SELECT month AS date, sid, volume AS x, fwd AS actual FROM scores),
 m AS (SELECT date, sum(1.0) FILTER (WHERE ok) AS n, sum(x / 1000) FILTER (WHERE ok) AS sx, sum(x / 1000 * x / 1000) FILTER (WHERE ok) AS sxx, sum(actual) FILTER (WHERE ok) AS sy, sum(x / 1000 * actual) FILTER (WHERE ok) AS sxy, max(ok::INT) AS one FROM (SELECT *, actual IS NOT NULL AND x IS NOT NULL AS ok FROM t) GROUP BY 1),
 c AS (SELECT date, sum(one) OVER w AS dates, sum(n) OVER w AS n, sum(sx) OVER w AS sx, sum(sxx) OVER w AS sxx, sum(sy) OVER w AS sy, sum(sxy) OVER w AS sxy FROM m WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 f AS (SELECT date, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b, (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n AS a FROM c WHERE dates >= 6)
SELECT t.date, t.sid, round(a + b * x / 1000, 5) AS forecast FROM t LEFT JOIN f ON t.date = f.date""")
def walk_forward_ols(spark, sf):
    t = v.month_scores(spark, sf).select(F.col("month").alias("date"), "sid", (F.col("volume") / 1000).alias("x"), F.col("fwd").alias("actual"))
    return forecast.walk_forward(t, ["x"]).select("date", "sid", r("forecast", 5))


@query(f"""WITH {v.SCORES}, p AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY volume DESC NULLS LAST, sid) AS n FROM scores WHERE volume IS NOT NULL)
SELECT month AS date, sid, fwd > quantile_cont(fwd, 0.5) OVER (PARTITION BY month) AS y FROM p WHERE n <= 30""")
def modelling_dataset(spark, sf):
    m = v.month_scores(spark, sf).withColumnsRenamed({"month": "date", "volume": "adv"})
    return forecast.modelling_rows(m.drop("fwd"), m, ["score"], 30).select("date", "sid", "y")


@query(None)
def ar3_forecast(spark, sf):
    return forecast.ar_forecasts(v.bars(spark, sf), horizon=5)


@query(f"""WITH {IC} SELECT month AS date, round(CASE WHEN count(ic) OVER w = 12 THEN avg(ic) OVER w END, 6) AS trailing FROM ics WINDOW w AS (ORDER BY month ROWS 11 PRECEDING)""")
def trailing_ic(spark, sf):
    ics = scoreboard.rank_ic(v.month_scores(spark, sf), ["month"], least=5).withColumnRenamed("month", "date")
    return scoreboard.trailing_mean(ics).select("date", r("trailing"))


@query(f"""WITH {v.SCORES}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY volume DESC NULLS LAST, sid) AS n FROM scores) WHERE n <= 40 AND score IS NOT NULL AND fwd IS NOT NULL),
 k AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY score DESC, sid) AS p FROM l), c AS (SELECT month FROM l GROUP BY 1 HAVING count(*) >= 2 AND max(score) > min(score) AND max(fwd) > min(fwd))
SELECT month AS date, round(avg(fwd), 6) AS top_mean FROM k JOIN c USING (month) WHERE p <= 5 GROUP BY 1""")
def liquid_top_mean(spark, sf):
    m = v.month_scores(spark, sf).withColumnsRenamed({"month": "date", "volume": "adv"})
    return scoreboard.liquid_grades(m, "sid", 40, 5).select("date", r("top_mean"))


@query(f"""WITH {v.MARKET}, sc AS (SELECT date, sid, -(exp(sum({LG}) OVER (PARTITION BY sid ORDER BY idx RANGE BETWEEN 20 PRECEDING AND CURRENT ROW)) - 1) AS score FROM market),
 f AS (SELECT date, idx, sid, sum({LG}) OVER (PARTITION BY sid ORDER BY idx RANGE BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS g FROM market), e AS (SELECT max(idx) AS e FROM market),
 j AS (SELECT m.date, m.sid, round(sc.score, 9) AS score, round(exp(coalesce(f.g, 0)) - 1, 9) AS fwd FROM market m JOIN sc ON m.date = sc.date AND m.sid = sc.sid JOIN f ON m.date = f.date AND m.sid = f.sid CROSS JOIN e WHERE m.month_end AND f.idx + 10 <= e),
 k AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0 AS b FROM j)
SELECT date, count(*) AS n, round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 6) AS ic FROM k GROUP BY 1 HAVING count(*) >= 3 AND stddev_pop(a) * stddev_pop(b) <> 0""")
def scoreboard_month_ends(spark, sf):
    m = v.market(spark, sf).withColumn("adv", F.col("close") * F.col("volume"))
    scores = signals.reversal(m, 21).withColumn("score", F.round("score", 9))
    fwd = scoreboard.forward_returns(m, 10).withColumn("fwd", F.round("fwd", 9))
    rows = m.filter("month_end").select("date", "sid").join(scores, ["date", "sid"]).join(fwd.select("date", "sid", "fwd"), ["date", "sid"])
    return scoreboard.rank_ic(rows, ["date"], least=3).select("date", "n", r("ic"))


@query(None)
def scoreboard_evaluate(spark, sf):
    m = v.market(spark, sf).withColumn("adv", F.col("close") * F.col("volume"))
    return scoreboard.evaluate(m, signals.reversal(m, 21), F.col("month_end"), {"all": None, "top20": 20}, [5, 21], least=3)
