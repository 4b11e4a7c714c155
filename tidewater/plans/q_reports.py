"""Queries of report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import report
from tidewater.plans import views as v
from tidewater.plans.kit import registrar

QUERIES, ORACLE, query = registrar()

HELD = """h AS (SELECT l_returnflag AS run, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_suppkey AS sid, CAST(sum(l_quantity) AS DOUBLE) AS weight
  FROM lineitem GROUP BY 1, 2, 3)"""


def _held(spark, sf):
    """Return flags as runs that hold the suppliers of a month by quantity."""
    month = F.to_date(F.date_trunc("month", "l_shipdate"))
    return v.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("run"), month.alias("date"), F.col("l_suppkey").alias("sid")).agg(F.sum("l_quantity").cast("double").alias("weight"))


@query(f"""WITH {HELD}, d AS (SELECT * FROM h WHERE weight <> 0 QUALIFY date = max(date) OVER (PARTITION BY run))
SELECT run, date, sid, weight, CAST(row_number() OVER (PARTITION BY run ORDER BY weight DESC, sid) AS INT) AS rank, count(*) OVER (PARTITION BY run) AS positions
FROM d QUALIFY rank <= 25""")
def latest_holdings(spark, sf):
    return report.latest_holdings(_held(spark, sf))


@query("""SELECT c_nationkey, c_name, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL AND c_mktsegment <> 'BUILDING'
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name) = 1""")
def best_other(spark, sf):
    return report.best_other(v.table(spark, sf, "customer"), ["c_nationkey"], "c_name", "c_acctbal", F.col("c_mktsegment") == "BUILDING")


@query(f"""WITH {HELD}, s AS (SELECT run, min(date) AS a, max(date) AS b FROM h GROUP BY 1), k AS (SELECT DISTINCT run, sid FROM h),
g AS (SELECT run, sid, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS date FROM k JOIN s USING (run))
SELECT run, sid, date, coalesce(weight, 0.0) AS weight FROM g LEFT JOIN h USING (run, sid, date)""")
def holdings_grid(spark, sf):
    return report.densify_months(_held(spark, sf), "run", "sid", "date", "weight")
