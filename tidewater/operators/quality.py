"""Hard invariants and measurements judged against their own past."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_keys(key: list[str]) -> Column:
    """Rows beyond the first of each key, null keys counted as values."""
    return F.count("*") - F.count_distinct(F.struct(*key))


def invariants(df: DataFrame, checks: dict[str, Column], key: list[str]) -> DataFrame:
    """(check, violations): one pass, one row for each check and one for duplicate keys."""
    named = {**checks}
    one = df.agg(*[F.count_if(c).alias(n) for n, c in named.items()], duplicate_keys(key).alias("duplicate_keys"))
    pairs = [F.struct(F.lit(n).alias("check"), F.col(n).cast("long").alias("violations")) for n in [*named, "duplicate_keys"]]
    return one.select(F.inline(F.array(*pairs)))


def judge(metrics: DataFrame, key: list[str], order: str, value: str = "value", least: int = 12) -> DataFrame:
    """Adds ``flag``: outside the range of all earlier values widened by their largest step; never before ``least`` values.
    A first record by at most a normal step isn't flagged, as the widening allows it."""
    w = Window.partitionBy(*key).orderBy(order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    step = F.abs(F.col(value) - F.lag(value).over(w))
    out = metrics.withColumn("_step", step)
    low, high, most = (f(c).over(past) for f, c in ((F.min, value), (F.max, value), (F.max, "_step")))
    count = F.count(value).over(past)
    out = out.withColumn("past", count).withColumn("flag", F.coalesce((count >= least) & ((F.col(value) > high + most) | (F.col(value) < low - most)), F.lit(False)))
    return out.drop("_step")


def agreement(a: DataFrame, b: DataFrame, key: list[str], value: str, month: Column, tolerance: float = 1e-3) -> DataFrame:
    """(month, n, agree): share of common rows whose values differ by at most the tolerance, relative to b's."""
    c = b.select(*key, F.col(value).alias("_b"))
    both = a.join(c, key).filter(F.col("_b") != 0)
    return both.groupBy(month.alias("month")).agg(F.count("*").alias("n"), F.avg((F.abs(F.col(value) / F.col("_b") - 1) <= tolerance).cast("double")).alias("agree"))


def monthly_stats(df: DataFrame, month: Column, value: str) -> DataFrame:
    """Count, share known, mean, spread and quantiles (linear) of a column per month."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.01, 0.25, 0.5, 0.75, 0.99)]))
    out = df.groupBy(month.alias("month")).agg(F.count("*").alias("n"), F.avg(F.col(value).isNotNull().cast("double")).alias("coverage"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), q.alias("_q"))
    return out.select("month", "n", "coverage", "mean", "sd", *[F.col("_q")[i].alias(n) for i, n in enumerate(("q01", "q25", "q50", "q75", "q99"))])
