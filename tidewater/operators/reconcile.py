"""One row for each key out of several sources' copies of a table; upserts and versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Order in which sources are trusted; others come last.
PRIORITY = ("sharadar", "alpaca", "edgar", "nasdaq", "tiingo", "fred")


def union_sources(copies: dict[str, DataFrame], priority=PRIORITY) -> DataFrame:
    """All copies with ``source`` and its ``rank``; columns that a copy lacks are null."""
    order = {s: i for i, s in enumerate(priority)}
    parts = [df.withColumn("source", F.lit(s)).withColumn("rank", F.lit(order.get(s, len(order)))) for s, df in sorted(copies.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_rows(df: DataFrame, key: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key by a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def reconcile(copies: dict[str, DataFrame], key: list[str], required: list[str], priority=PRIORITY) -> DataFrame:
    """Per key the row with most required columns known, then of the most trusted source."""
    rows = union_sources(copies, priority)
    complete = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in required], F.lit(0))
    return first_rows(rows.withColumn("_c", complete), key, [F.desc("_c"), "rank", "source"]).drop("_c", "rank")


def handoff(copies: dict[str, DataFrame], key: str = "sid", date: str = "date", priority=PRIORITY) -> DataFrame:
    """Prices: an entity's rows of its first source, and later rows of others only if that source still follows it, that is,
    if the entity's last day there is the source's newest day. The statistics are over all rows, whatever is read afterwards."""
    rows = union_sources(copies, priority)
    newest = rows.groupBy("source").agg(F.max(date).alias("_newest"))
    spans = rows.groupBy(key, "source", "rank").agg(F.max(date).alias("_last"))
    first = first_rows(spans, [key], ["rank", "source"]).select(key, F.col("source").alias("_first"), "_last")
    first = first.join(F.broadcast(newest), first["_first"] == newest["source"]).select(key, "_first", "_last", (F.col("_last") == F.col("_newest")).alias("_alive"))
    kept = rows.join(first, key).filter((F.col("source") == F.col("_first")) | (F.col("_alive") & (F.col(date) > F.col("_last"))))
    return first_rows(kept, [key, date], ["rank", "source"]).drop("_first", "_last", "_alive", "rank")


def upsert(old: DataFrame, new: DataFrame, key: list[str], arrival: list) -> DataFrame:
    """``old`` with ``new``'s rows in place of those of the same key; of new rows of a key the last by ``arrival`` counts."""
    latest = first_rows(new, key, arrival)
    kept = old.join(latest.select(*key), [old[k].eqNullSafe(latest[k]) for k in key], "left_anti")
    return kept.unionByName(latest, allowMissingColumns=True)


def latest_version(rows: DataFrame, key: list[str], version: list) -> DataFrame:
    """The newest version of each key by a total descending order."""
    return first_rows(rows, key, version)


def changed(old: DataFrame, new: DataFrame) -> bool:
    """Whether the tables differ in any row."""
    return bool(old.exceptAll(new).take(1) or new.exceptAll(old).take(1))


def later_product(rows: DataFrame, events: DataFrame, key: str, date: str, event_date: str, factor: str, until=None, row_key: list[str] | None = None, out: str = "factor") -> DataFrame:
    """``rows`` with the product of the factors of the key's events after the row's date (and not after ``until``); 1 without any.

    Without ``until`` one pass a key, newest first, carries the product along. With it a row meets the key's events of its own span
    only through a join on the key: a quotient of two running products would round differently and fail at a factor of 0."""
    row_key = row_key or rows.columns
    if until is None:
        e = events.select(F.col(key).alias("_k"), F.col(event_date).alias("_at"), F.lit(1).alias("_tag"), F.col(factor).cast("double").alias("_f"))
        probes = rows.select(F.col(key).alias("_k"), F.col(date).alias("_at"), F.lit(0).alias("_tag"), F.lit(None).cast("double").alias("_f")).distinct()
        newer = Window.partitionBy("_k").orderBy(F.desc("_at"), "_tag").rowsBetween(Window.unboundedPreceding, 0)
        products = e.unionByName(probes).filter("_k is not null and _at is not null").withColumn(out, F.product("_f").over(newer)).filter("_tag = 0")
        products = products.select(F.col("_k").alias(key), F.col("_at").alias(date), out)
        return rows.join(products, [key, date], "left").select(*rows.columns, F.coalesce(out, F.lit(1.0)).alias(out))
    e = events.select(F.col(key).alias("_k"), F.col(event_date).alias("_ed"), F.col(factor).alias("_f"))
    cond = (F.col(key) == F.col("_k")) & (F.col("_ed") > F.col(date)) & (F.col("_ed") <= until)
    hits = rows.select(key, date, *[c for c in row_key if c not in (key, date)]).join(e, cond)
    products = hits.groupBy(*row_key).agg(F.product("_f").alias(out))
    return rows.join(products, row_key, "left").withColumn(out, F.coalesce(out, F.lit(1.0)))
