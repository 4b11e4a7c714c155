"""Performance of return series: metrics, scorecards, fund comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.windows import islands

YEAR = 252


def underwater(returns: DataFrame, key: str, date: str = "date", ret: str = "ret") -> DataFrame:
    """Adds nav (growth of 1), drawdown (start included) and island (unbroken runs under water or not)."""
    w = Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    d = returns.withColumn("nav", F.exp(F.sum(F.log1p(ret)).over(w)))
    d = d.withColumn("drawdown", F.col("nav") / F.greatest(F.max("nav").over(w), F.lit(1.0)) - 1)
    return islands(d, [key], date, F.col("drawdown") < 0)


def performance(returns: DataFrame, key: str, date: str = "date", ret: str = "ret", rf: str | None = None, benchmark: str | None = None) -> DataFrame:
    """(key, n, total, cagr, vol, sharpe, sortino, max_drawdown, longest_underwater[, beta, alpha, tracking_error, information_ratio])."""
    d = underwater(returns, key, date, ret)
    runs = d.groupBy(key, "island").agg(F.count(F.when(F.col("drawdown") < 0, 1)).alias("_len")).groupBy(key).agg(F.max("_len").alias("longest_underwater"))
    r = F.col(ret)
    x = r - (F.col(rf) if rf else F.lit(0.0))
    down = F.sqrt(F.avg(F.least(x, F.lit(0.0)) * F.least(x, F.lit(0.0))))
    aggs = [
        F.count("*").alias("n"),
        F.expm1(F.sum(F.log1p(r))).alias("total"),
        F.expm1(F.sum(F.log1p(r)) * YEAR / F.count("*")).alias("cagr"),
        (F.stddev_samp(r) * F.sqrt(F.lit(float(YEAR)))).alias("vol"),
        F.try_divide(F.avg(x) * F.sqrt(F.lit(float(YEAR))), F.stddev_samp(x)).alias("sharpe"),
        F.try_divide(F.avg(x) * F.sqrt(F.lit(float(YEAR))), down).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"),
    ]
    if benchmark:
        b = F.col(benchmark)
        beta = F.try_divide(F.covar_samp(r, b), F.var_samp(b))
        aggs += [beta.alias("beta"), ((F.avg(r) - beta * F.avg(b)) * YEAR).alias("alpha"), (F.stddev_samp(r - b) * F.sqrt(F.lit(float(YEAR)))).alias("tracking_error"), F.try_divide(F.avg(r - b) * F.sqrt(F.lit(float(YEAR))), F.stddev_samp(r - b)).alias("information_ratio")]
    return d.groupBy(key).agg(*aggs).join(runs, key)


def eras(returns: DataFrame, key: str, era: Column, ret: str = "ret") -> DataFrame:
    """(key, era, n, growth a year, volatility) by a label of dates."""
    r = F.col(ret)
    return returns.groupBy(key, era.alias("era")).agg(F.count("*").alias("n"), F.expm1(F.sum(F.log1p(r)) * YEAR / F.count("*")).alias("cagr"), (F.stddev_samp(r) * F.sqrt(F.lit(float(YEAR)))).alias("vol"))


def years_won(a: DataFrame, b: DataFrame, date: str = "date", ret: str = "ret") -> DataFrame:
    """One row: calendar years in which a's compounded return beats b's, and those it loses, on common dates."""
    both = a.select(date, F.col(ret).alias("_a")).join(b.select(date, F.col(ret).alias("_b")), date)
    y = both.groupBy(F.year(date).alias("year")).agg(F.sum(F.log1p("_a")).alias("x"), F.sum(F.log1p("_b")).alias("y"))
    return y.agg(F.count_if(F.col("x") > F.col("y")).alias("won"), F.count_if(F.col("x") < F.col("y")).alias("lost"))


def worst_relative(a: DataFrame, b: DataFrame, rows: int = 756, date: str = "date", ret: str = "ret") -> DataFrame:
    """One row: the worst growth of a against b over ``rows`` common dates."""
    both = a.select(date, F.col(ret).alias("_a")).join(b.select(date, F.col(ret).alias("_b")), date)
    w = Window.orderBy(date)  # one series
    g = both.withColumn("_g", F.sum(F.log1p("_a") - F.log1p("_b")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.withColumn("_x", F.expm1(F.col("_g") - F.lag("_g", rows).over(w))).agg(F.min("_x").alias("worst"))


def compare_windows(returns: DataFrame, key: str, periods: DataFrame, date: str = "date", ret: str = "ret") -> DataFrame:
    """Performance of each series in each period (name, first, last): a broadcast range join with one row a period."""
    long = returns.join(F.broadcast(periods), (F.col(date) >= F.col("first")) & (F.col(date) <= F.col("last")))
    packed = long.withColumn("_key", F.concat_ws("|", F.col(key).cast("string"), "name"))
    names = packed.select("_key", F.col(key), "name").distinct()
    return performance(packed.select("_key", date, ret), "_key", date, ret).join(names, "_key").drop("_key")


def horizons(growth: DataFrame, key: str, years: list[int], date: str = "date", value: str = "nav") -> DataFrame:
    """(key, years, cagr): growth a year up to the key's last date; null where its history is shorter."""
    end = growth.groupBy(key).agg(F.max(date).alias("_end"), F.max_by(value, date).alias("_last"), F.min(date).alias("_first"))
    grid = end.select("*", F.explode(F.array(*map(F.lit, years))).alias("years")).withColumn("_from", F.date_sub("_end", F.round(F.col("years") * 365.25).cast("int")))
    base = growth.select(F.col(key).alias("_k"), F.col(date).alias("_d"), F.col(value).alias("_v"))
    hit = grid.join(base, (F.col(key) == F.col("_k")) & (F.col("_d") <= F.col("_from")), "left")
    out = hit.groupBy(key, "years", "_last").agg(F.max_by("_v", "_d").alias("_then"))
    return out.select(key, "years", (F.pow(F.col("_last") / F.col("_then"), 1.0 / F.col("years")) - 1).alias("cagr"))


def weekly_points(series: DataFrame, key: str, date: str = "date", value: str = "nav") -> DataFrame:
    """(key, date, value): the last row of each calendar week (from Monday) and the first row of all."""
    week = F.date_trunc("week", F.col(date))
    last = series.groupBy(key, week.alias("_w")).agg(F.max(date).alias(date), F.max_by(value, date).alias(value)).drop("_w")
    first = series.groupBy(key).agg(F.min(date).alias(date), F.min_by(value, date).alias(value))
    return last.unionByName(first).distinct()


def rebased(series: DataFrame, key: str, start, date: str = "date", value: str = "nav") -> DataFrame:
    """Each series from ``start`` on, divided by its first value there."""
    w = Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return series.filter(F.col(date) >= start).withColumn(value, F.col(value) / F.first(value).over(w))


def held_since(states: DataFrame, key: str, value: str, date: str = "date") -> DataFrame:
    """(key, value, since): the newest value and the first date of its unbroken run."""
    runs = islands(states, [key], date, F.col(value))
    w = Window.partitionBy(key)
    return runs.withColumn("_m", F.max("island").over(w)).filter("island = _m").groupBy(key, value).agg(F.min(date).alias("since"))
