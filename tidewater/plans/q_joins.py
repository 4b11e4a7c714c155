"""Queries of reconciliation, intervals and as-of joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import asof, classify, ids, intervals, quality, reconcile
from tidewater.plans import views as v
from tidewater.plans.kit import r, registrar

QUERIES, ORACLE, query = registrar()


@query(f"""WITH {v.SOURCES} SELECT sid, date, total, top, source FROM (SELECT *, row_number() OVER (PARTITION BY sid, date ORDER BY (total IS NOT NULL)::INT + (top IS NOT NULL)::INT DESC, rank) AS n FROM src) WHERE n = 1""")
def reconcile_sources(spark, sf):
    return reconcile.reconcile(v.sources(spark, sf), ["sid", "date"], ["total", "top"]).select("sid", "date", "total", "top", "source")


@query(f"""WITH {v.SOURCES}, newest AS (SELECT source, max(date) AS newest FROM src GROUP BY 1), spans AS (SELECT sid, source, rank, max(date) AS last FROM src GROUP BY 1, 2, 3),
first AS (SELECT s.sid, s.source, s.last, s.last = n.newest AS alive FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY rank) AS k FROM spans) s JOIN newest n USING (source) WHERE k = 1),
kept AS (SELECT src.* FROM src JOIN first f ON src.sid = f.sid WHERE src.source = f.source OR (f.alive AND src.date > f.last))
SELECT sid, date, total, source FROM (SELECT *, row_number() OVER (PARTITION BY sid, date ORDER BY rank) AS n FROM kept) WHERE n = 1""")
def price_handoff(spark, sf):
    return reconcile.handoff(v.sources(spark, sf)).select("sid", "date", "total", "source")


@query("""
WITH new AS (SELECT o_orderkey, o_custkey + 1 AS o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 5 = 0)
SELECT o_orderkey, o_custkey, o_totalprice FROM new UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)""")
def upsert_keys(spark, sf):
    o = v.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    a = o.filter("o_orderkey % 3 = 0").withColumn("o_custkey", F.col("o_custkey") + 1)
    b = o.filter("o_orderkey % 5 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 1000000000)
    return reconcile.upsert(o, a.unionByName(b), ["o_orderkey"], [F.desc("o_totalprice")])


@query("SELECT o_custkey, o_orderstatus, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_version(spark, sf):
    o = v.table(spark, sf, "orders")
    return reconcile.latest_version(o, ["o_custkey", "o_orderstatus"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")


PROBES = """probes AS (SELECT DISTINCT l_partkey % 97 AS ticker, CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE l_linenumber = 1)"""


@query(f"""WITH {v.EPISODES}, {PROBES}, one AS (SELECT p.ticker, p.date, count(*) FILTER (WHERE dated) AS nd, min(sid) FILTER (WHERE dated) AS sd, count(DISTINCT sid) FILTER (WHERE NOT dated) AS nu, min(sid) FILTER (WHERE NOT dated) AS su
 FROM probes p JOIN episodes e ON p.ticker = e.ticker AND p.date >= e."from" AND p.date <= coalesce(e."to", DATE '2999-12-31') GROUP BY 1, 2)
SELECT p.ticker, p.date, CASE WHEN nd = 1 THEN sd WHEN nd = 0 AND nu = 1 THEN su END AS sid FROM probes p LEFT JOIN one USING (ticker, date)""")
def interval_lookup(spark, sf):
    p = v.table(spark, sf, "lineitem").filter("l_linenumber = 1").select((F.col("l_partkey") % 97).alias("ticker"), F.to_date("l_shipdate").alias("date")).distinct()
    return intervals.lookup(v.episodes(spark, sf), p).select("ticker", "date", "sid")


@query(f"""WITH {v.EPISODES}, {PROBES} SELECT p.ticker, p.date, count(DISTINCT e.sid) AS covering FROM probes p LEFT JOIN episodes e ON p.ticker = e.ticker AND p.date >= e."from" AND p.date <= coalesce(e."to", DATE '2999-12-31') GROUP BY 1, 2""")
def interval_covering(spark, sf):
    p = v.table(spark, sf, "lineitem").filter("l_linenumber = 1").select((F.col("l_partkey") % 97).alias("ticker"), F.to_date("l_shipdate").alias("date")).distinct()
    return intervals.covering(v.episodes(spark, sf), p).select("ticker", "date", "covering")


@query(f"""WITH {v.EPISODES}, e AS (SELECT sid, sid % 701 AS ticker, "from" AS f, coalesce("to", DATE '2999-12-31') AS t FROM episodes)
SELECT DISTINCT a.ticker, a.sid, b.sid AS other FROM e a JOIN e b ON a.ticker = b.ticker AND a.sid < b.sid AND a.f <= b.t AND b.f <= a.t""")
def interval_overlap(spark, sf):
    return intervals.shared_names(v.episodes(spark, sf).withColumn("ticker", F.col("sid") % 701))


@query("""
WITH f AS (SELECT o_custkey AS sid, o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS s FROM orders)
SELECT a.o_orderkey, round(coalesce(product(CASE WHEN b.s = 'F' THEN 2.0 ELSE 0.5 END) FILTER (WHERE b.o_orderkey IS NOT NULL), 1.0), 6) AS factor
FROM f a LEFT JOIN f b ON a.sid = b.sid AND b.d > a.d AND b.s <> 'O' GROUP BY 1""")
def later_splits_product(spark, sf):
    f = v.filings(spark, sf)
    e = f.filter("form <> 'O'").select("sid", F.col("filed").alias("ed"), F.when(F.col("form") == "F", 2.0).otherwise(0.5).alias("f"))
    out = reconcile.later_product(f.select("sid", F.col("accn").alias("o_orderkey"), "filed"), e, "sid", "filed", "ed", "f", row_key=["o_orderkey"])
    return out.select("o_orderkey", r("factor"))


GRID = """grid AS (SELECT c.c_custkey AS sid, m.d FROM customer c CROSS JOIN (SELECT DISTINCT last_day(CAST(o_orderdate AS DATE)) AS d FROM orders WHERE year(o_orderdate) = 1998) m)"""


def _grid(spark, sf):
    d = v.table(spark, sf, "orders").filter(F.year("o_orderdate") == 1998).select(F.last_day("o_orderdate").alias("d")).distinct()
    return v.table(spark, sf, "customer").select(F.col("c_custkey").alias("sid")).crossJoin(F.broadcast(d))  # twelve month ends


@query(f"""WITH {v.FILINGS}, {GRID}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid, filed ORDER BY accn DESC) AS n FROM filings) WHERE n = 1)
SELECT g.sid, g.d, CASE WHEN date_diff('day', f.filed, g.d) <= 550 THEN f.accn END AS accn FROM grid g ASOF LEFT JOIN f ON g.sid = f.sid AND g.d > f.filed""")
def asof_backward_strict(spark, sf):
    return asof.asof_backward(_grid(spark, sf), v.filings(spark, sf), ["sid"], "d", "filed", ["accn"], strict=True, tiebreak=["accn"], max_age_days=550)


@query(f"""WITH {v.SERIES}, days AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events), g AS (SELECT date, series FROM days CROSS JOIN (SELECT DISTINCT series FROM series))
SELECT g.date, g.series, round(s.value, 6) AS value FROM g ASOF LEFT JOIN series s ON g.series = s.series AND g.date >= s.available""")
def asof_backward(spark, sf):
    from tidewater.operators.context import known_at

    days = v.table(spark, sf, "events").select(F.to_date("ts").alias("date")).distinct()
    return known_at(days, v.series(spark, sf)).select("date", "series", r("value"))


@query(f"""WITH {v.FILINGS}, p AS (SELECT a.accn, b.accn AS prior, abs(date_diff('day', b.period_end, a.period_end - 365)) AS gap, b.period_end AS e FROM filings a LEFT JOIN filings b ON a.sid = b.sid AND abs(date_diff('day', b.period_end, a.period_end - 365)) <= 20)
SELECT accn, prior FROM (SELECT *, row_number() OVER (PARTITION BY accn ORDER BY gap, e DESC, prior DESC) AS n FROM p) WHERE n = 1""")
def asof_nearest_tolerance(spark, sf):
    f = v.filings(spark, sf)
    left = f.select("sid", "accn", F.date_sub("period_end", 365).alias("want"))
    right = f.select("sid", F.col("accn").alias("prior"), "period_end")
    return asof.asof_nearest(left, right, ["sid"], "want", "period_end", ["prior"], 20, tiebreak=["prior"], row_key=["accn"]).select("accn", "prior")


@query(f"""WITH {v.FILINGS}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid, form, filed ORDER BY accn DESC) AS n FROM filings) WHERE n = 1)
SELECT g.accn, f.amount FROM (SELECT accn, sid, form, filed + 30 AS at FROM filings) g ASOF LEFT JOIN f ON g.sid = f.sid AND g.form = f.form AND g.at >= f.filed""")
def asof_composite_key(spark, sf):
    f = v.filings(spark, sf)
    return asof.asof_backward(f.select("accn", "sid", "form", F.date_add("filed", 30).alias("at")), f.select("sid", "form", "filed", "amount", F.col("accn").alias("tie")), ["sid", "form"], "at", "filed", ["amount"], tiebreak=["tie"]).select("accn", "amount")


@query("SELECT c_custkey, 'anti' AS kind FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) UNION ALL SELECT c_custkey, 'semi' FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_semi(spark, sf):
    c, o = v.table(spark, sf, "customer").select("c_custkey"), v.table(spark, sf, "orders")
    a = c.join(o.filter("o_totalprice > 300000"), c["c_custkey"] == o["o_custkey"], "left_anti").withColumn("kind", F.lit("anti"))
    return a.unionByName(c.join(o.filter("o_orderstatus = 'P'"), c["c_custkey"] == o["o_custkey"], "left_semi").withColumn("kind", F.lit("semi")))


@query("""
WITH a AS (SELECT user_id, count(*) AS clicks FROM events WHERE event_type = 'click' AND user_id % 3 <> 0 GROUP BY 1), b AS (SELECT user_id, count(*) AS views FROM events WHERE event_type = 'view' AND user_id % 4 <> 0 GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, clicks, views FROM a FULL JOIN b ON a.user_id = b.user_id""")
def full_outer_coalesce(spark, sf):
    e = v.table(spark, sf, "events")
    a = e.filter("event_type = 'click' and user_id % 3 <> 0").groupBy("user_id").agg(F.count("*").alias("clicks"))
    return a.join(e.filter("event_type = 'view' and user_id % 4 <> 0").groupBy("user_id").agg(F.count("*").alias("views")), "user_id", "full")


@query(f"""WITH {v.SOURCES}, b AS (SELECT sid, date, total FROM src WHERE source = 'alpaca' AND total <> 0)
SELECT CAST(date_trunc('week', a.date) AS DATE) AS month, count(*) AS n, round(avg(CASE WHEN abs(a.total / b.total - 1) <= 0.001 THEN 1.0 ELSE 0 END), 6) AS agree FROM src a JOIN b ON a.sid = b.sid AND a.date = b.date WHERE a.source = 'sharadar' GROUP BY 1""")
def source_agreement(spark, sf):
    s = v.sources(spark, sf)
    return quality.agreement(s["sharadar"].select("sid", "date", "total"), s["alpaca"], ["sid", "date"], "total", F.trunc("date", "week")).select("month", "n", r("agree"))


@query("""
SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'adr' WHEN regexp_matches(p_name, '(?i)\\bbolt\\b') THEN 'preferred' WHEN p_type = 'ECONOMY' THEN 'fund' WHEN p_size < 5 THEN 'unit' END AS reason FROM part""")
def classify_rules(spark, sf):
    from tidewater.functions.scalars import first_match

    c = F.col
    rules = [(c("p_name").contains("ring"), "adr"), (c("p_name").rlike(r"(?i)\bbolt\b"), "preferred"), (c("p_type") == "ECONOMY", "fund"), (c("p_size") < 5, "unit")]
    return v.table(spark, sf, "part").select("p_partkey", first_match(rules).alias("reason"))


@query("""
WITH s AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN p_name || ' Warrants' WHEN p_partkey % 5 = 0 THEN p_name || ' Fund' ELSE p_name || ' Common Stock' END AS name, 'S' || p_partkey || CASE WHEN p_partkey % 11 = 0 THEN '.U' WHEN p_partkey % 13 = 0 THEN '-WS' ELSE '' END AS symbol, p_partkey % 17 = 0 AS test, p_partkey % 19 = 0 AS etf FROM part)
SELECT upper(replace(symbol, '-', '.')) AS symbol, CASE WHEN test THEN 'test' WHEN etf THEN 'etf' WHEN symbol LIKE '%-WS' THEN 'warrant' WHEN symbol LIKE '%.U' THEN 'unit' WHEN name LIKE '%Warrants' THEN 'warrant' WHEN name LIKE '%Fund' THEN 'fund' END AS exclude_reason FROM s""")
def listing_classes(spark, sf):
    k = F.col("p_partkey")
    p = v.table(spark, sf, "part")
    name = F.concat("p_name", F.when(k % 7 == 0, " Warrants").when(k % 5 == 0, " Fund").otherwise(" Common Stock"))
    symbol = F.concat(F.lit("S"), k.cast("string"), F.when(k % 11 == 0, ".U").when(k % 13 == 0, "-WS").otherwise(""))
    return classify.classify(p.select(symbol.alias("symbol"), name.alias("name"), (k % 17 == 0).alias("test_issue"), (k % 19 == 0).alias("etf"))).select("symbol", "exclude_reason")


@query("SELECT word, count(*) AS n, count(DISTINCT p_partkey) AS parts FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1")
def split_explode(spark, sf):
    w = v.table(spark, sf, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("p_partkey").alias("parts"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def json_props(spark, sf):
    e = v.table(spark, sf, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("total"))


@query("""
WITH o AS (SELECT o_custkey AS sid, CAST(o_orderdate AS DATE) AS date, o_orderkey, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'O'),
c AS (SELECT sid, date, 'N' || o_orderkey AS old FROM o WHERE k = 1), t AS (SELECT c_custkey AS sid, 'C' || c_custkey AS ticker, DATE '1995-01-01' AS first FROM customer),
seg AS (SELECT c.sid, c.old AS ticker, coalesce(lag(date) OVER (PARTITION BY c.sid ORDER BY date), t.first) AS "from", date - 1 AS "to" FROM c JOIN t USING (sid)
UNION ALL SELECT t.sid, t.ticker, coalesce(m.at, t.first), NULL FROM t LEFT JOIN (SELECT sid, max(date) AS at FROM c GROUP BY 1) m USING (sid))
SELECT sid, ticker, "from", "to" FROM seg WHERE "to" IS NULL OR "from" <= "to" """)
def name_segments(spark, sf):
    o = v.table(spark, sf, "orders").filter("o_orderstatus <> 'O'").select(F.col("o_custkey").alias("sid"), F.to_date("o_orderdate").alias("date"), "o_orderkey")
    one = reconcile.first_rows(o, ["sid", "date"], ["o_orderkey"]).select("sid", "date", F.concat(F.lit("N"), F.col("o_orderkey").cast("string")).alias("old"))
    t = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("sid"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"), F.lit("1995-01-01").cast("date").alias("first"))
    return ids.name_segments(t, one).select("sid", "ticker", "from", "to")


@query("""
WITH RECURSIVE p AS (SELECT p_partkey AS sid, (p_partkey - p_partkey % 7) // 2 AS root FROM part WHERE p_partkey % 3 = 0 AND (p_partkey - p_partkey % 7) // 2 < p_partkey),
w(sid, root, k) AS (SELECT sid, root, 0 FROM p UNION ALL SELECT w.sid, p.root, k + 1 FROM w JOIN p ON w.root = p.sid)
SELECT sid, arg_max(root, k) AS root FROM w GROUP BY sid""")
def merge_chains(spark, sf):
    c = F.col("p_partkey")
    step = v.table(spark, sf, "part").filter(c % 3 == 0).select(c.alias("sid"), F.floor((c - c % 7) / 2).cast("long").alias("into")).filter("into < sid")
    for _ in range(6):  # chains are shorter than 2 ** 6
        nxt = step.select(F.col("sid").alias("_s"), F.col("into").alias("_i"))
        step = step.join(nxt, F.col("into") == F.col("_s"), "left").select("sid", F.coalesce("_i", "into").alias("into"))
    return step.withColumnRenamed("into", "root")


@query("""SELECT o_custkey AS sid, CAST(dense_rank() OVER (ORDER BY f, o_custkey) AS INTEGER) AS h FROM (SELECT o_custkey, min(o_orderkey) AS f FROM orders GROUP BY 1)""")
def anonymised_keys(spark, sf):
    first = v.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("sid")).agg(F.min("o_orderkey").alias("f"))
    return first.select("sid", F.dense_rank().over(Window.orderBy("f", "sid")).alias("h"))  # one row a key of a run
