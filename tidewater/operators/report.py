"""Tables behind reports: the newest holdings of runs, the best other fund, grids without holes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_holdings(holdings: DataFrame, top: int = 25) -> DataFrame:
    """The ``top`` largest weights of each run's newest day, with their rank and the day's number of positions.

    ``holdings`` has (run, date, sid, weight). A null or zero weight is no position; equal weights go by sid.
    """
    held = holdings.filter("weight <> 0")
    newest = held.groupBy("run").agg(F.max("date").alias("date"))
    day = held.join(newest, ["run", "date"])
    count = day.groupBy("run").agg(F.count("*").alias("positions"))
    by_size = Window.partitionBy("run").orderBy(F.desc("weight"), "sid")
    return day.withColumn("rank", F.row_number().over(by_size)).filter(F.col("rank") <= top).join(count, "run")


def best_other(funds: DataFrame, keys: list[str], name: str, value: str, ours: Column) -> DataFrame:
    """The name with the largest ``value`` of each group among rows that aren't ours; equal values go to the lesser name.

    Rows without a value or of which it isn't known whether they are ours don't take part; a group without others has no row.
    """
    best = F.min_by(F.struct(name, value), F.struct(-F.col(value), F.col(name))).alias("_best")
    return funds.filter(F.col(value).isNotNull() & ~ours).groupBy(*keys).agg(best).select(*keys, "_best.*")


def densify_months(rows: DataFrame, group: str, key: str, month: str, value: str) -> DataFrame:
    """(group, key, month, value) with a row for every month of the group's span and each of its keys; zero where there was none.

    Months are first days; rows without a month or key are left out, and repeated rows of a cell are added up.
    """
    cells = rows.filter(F.col(month).isNotNull() & F.col(key).isNotNull()).groupBy(group, key, month).agg(F.sum(value).alias(value))
    span = cells.groupBy(group).agg(F.min(month).alias("_a"), F.max(month).alias("_b"))
    grid = cells.select(group, key).distinct().join(span, group)
    grid = grid.select(group, key, F.explode(F.sequence("_a", "_b", F.expr("INTERVAL 1 MONTH"))).alias(month))
    return grid.join(cells, [group, key, month], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))
