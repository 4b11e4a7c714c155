"""Permanent entity ids: built from vendor tables, extended, refreshed without renumbering, merged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.lineage import cut
from tidewater.functions.scalars import first_match
from tidewater.operators.intervals import shared_names
from tidewater.operators.reconcile import first_rows

# First self-assigned id; days between first days that still make one listing.
RESERVED, SAME_LISTING_DAYS = 100_000_000, 10
#: Rounds that follow any chain of 64-bit ids to its end.
MAX_ROUNDS = 64
#: Ordered parts of a vendor's category and what they mean.
CATEGORIES = (("adr", "adr"), ("preferred", "preferred"), ("warrant", "warrant"), ("etf", "fund"), ("cef", "fund"), ("etn", "fund"), ("fund", "fund"), ("common", "common"))


@dataclass
class Ids:
    """securities (sid, name, exchange, category, first, last, ...), names (sid, ticker, from, to, dated), merged (sid, into)."""

    securities: DataFrame
    names: DataFrame
    merged: DataFrame | None = None


def category(column):
    """The first category whose word the vendor's text holds, else ``other``."""
    low = F.lower(column)
    return first_match([(low.contains(word), label) for word, label in CATEGORIES], "other")


def name_segments(tickers: DataFrame, changes: DataFrame) -> DataFrame:
    """(sid, ticker, from, to, dated): tickers (sid, ticker, first, last) hold the current name; changes (sid, date, old) the earlier
    ones. A name starts at the change before it, or the first day, and ends the day before its own; empty spans drop out."""
    w = Window.partitionBy("sid").orderBy("date")
    c = changes.join(tickers.select("sid", "first"), "sid")
    past = c.select("sid", F.col("old").alias("ticker"), F.coalesce(F.lag("date").over(w), F.col("first")).alias("from"), F.date_sub("date", 1).alias("to"))
    last = changes.groupBy("sid").agg(F.max("date").alias("_at"))
    now = tickers.join(last, "sid", "left").select("sid", "ticker", F.coalesce("_at", "first").alias("from"), F.lit(None).cast("date").alias("to"))
    return past.unionByName(now).filter(F.col("to").isNull() | (F.col("from") <= F.col("to"))).withColumn("dated", F.lit(True))


def related_names(tickers: DataFrame, dated: DataFrame) -> DataFrame:
    """Undated names out of a space-separated ``related`` column, unless the entity holds the name dated already."""
    r = tickers.select("sid", F.explode(F.split(F.trim("related"), r"\s+")).alias("ticker"), F.col("first").alias("from"), F.col("last").alias("to"), F.lit(False).alias("dated")).filter("ticker <> ''")
    return r.join(dated.select("sid", "ticker"), ["sid", "ticker"], "left_anti").distinct()


def extend(ids: Ids, new: DataFrame) -> Ids:
    """Append securities (ticker, name, exchange, category, first) with numbers after the largest reserved one, by ticker and first day."""
    top = ids.securities.agg(F.greatest(F.coalesce(F.max("sid"), F.lit(0)), F.lit(RESERVED - 1)).alias("_top"))
    w = Window.orderBy("ticker", "first")  # new listings only: a handful a day
    n = new.withColumn("_n", F.row_number().over(w)).crossJoin(F.broadcast(top)).withColumn("sid", (F.col("_top") + F.col("_n")).cast("long"))
    securities = ids.securities.unionByName(n.select("sid", "name", "exchange", "category", "first"), allowMissingColumns=True)
    names = ids.names.unionByName(n.select("sid", "ticker", F.col("first").alias("from"), F.lit(None).cast("date").alias("to"), F.lit(True).alias("dated")))
    return Ids(securities, names, ids.merged)


def adopt(reserved: DataFrame, fresh: DataFrame) -> DataFrame:
    """(permaticker, sid): vendor listings (permaticker, ticker, first) that are a reserved entity (sid, ticker, first) under a name and a
    first day within the tolerance; the nearest, one for each."""
    r = reserved.select("sid", F.col("ticker").alias("_t"), F.col("first").alias("_f"))
    gap = F.abs(F.datediff("first", "_f"))
    hits = fresh.join(r, (F.col("ticker") == F.col("_t")) & (gap <= SAME_LISTING_DAYS)).withColumn("_gap", gap)
    one = first_rows(hits, ["permaticker"], ["_gap", "sid"])
    return first_rows(one, ["sid"], ["_gap", "permaticker"]).select("permaticker", "sid")


def refresh(known: DataFrame, fresh: DataFrame, reserved: DataFrame | None = None) -> DataFrame:
    """(permaticker, sid) of all listings ever: known ones keep theirs, new ones adopt a reserved one or take their own number."""
    new = fresh.join(known, "permaticker", "left_anti")
    if reserved is not None:
        new = new.join(adopt(reserved, new), "permaticker", "left")
    else:
        new = new.withColumn("sid", F.lit(None).cast("long"))
    out = known.select("permaticker", "sid").unionByName(new.select("permaticker", F.coalesce("sid", "permaticker").alias("sid")))
    if out.groupBy("permaticker").agg(F.countDistinct("sid").alias("n")).filter("n > 1").take(1):
        raise ValueError("a listing would change its id")
    return out


def merges(ids: Ids) -> DataFrame:
    """(sid, into): self-made entities that share a name and days with another: into the one numbered entity, else the smallest
    self-made; chains are followed to their end by doubling."""
    both = shared_names(ids.names)
    pairs = both.select("sid", "other").unionByName(both.select(F.col("other").alias("sid"), F.col("sid").alias("other"))).filter(F.col("sid") >= RESERVED)
    g = pairs.groupBy("sid").agg(
        F.countDistinct(F.when(F.col("other") < RESERVED, F.col("other"))).alias("_n"),
        F.min(F.when(F.col("other") < RESERVED, F.col("other"))).alias("_numbered"),
        F.min(F.when((F.col("other") >= RESERVED) & (F.col("other") < F.col("sid")), F.col("other"))).alias("_own"),
    )
    step = g.select("sid", F.when(F.col("_n") == 1, F.col("_numbered")).otherwise(F.col("_own")).alias("into")).filter("into is not null")
    # Each round doubles the length of the chains followed; they lead to ever smaller ids, so they end.
    for _ in range(MAX_ROUNDS):
        step = cut(step)
        nxt = step.select(F.col("sid").alias("_s"), F.col("into").alias("_i"))
        if not step.join(nxt, F.col("into") == F.col("_s"), "left_semi").take(1):
            return step
        step = step.join(nxt, F.col("into") == F.col("_s"), "left").select("sid", F.coalesce("_i", "into").alias("into"))
    raise RuntimeError("chains of merges did not end")


def merge(ids: Ids) -> Ids:
    """Names of merged entities go to what they merge into; nothing is deleted, as ``merged`` keeps the link."""
    m = merges(ids)
    moved = ids.names.join(m, "sid", "left").withColumn("sid", F.coalesce("into", "sid")).drop("into")
    kept = ids.securities.join(m, "sid", "left_anti")
    return Ids(kept, moved.distinct(), m if ids.merged is None else ids.merged.unionByName(m))


def resolve(probes: list[DataFrame], key: list[str]) -> DataFrame:
    """The first known ``sid`` of several look-ups of the same rows."""
    out = probes[0].withColumnRenamed("sid", "_s0")
    for i, p in enumerate(probes[1:], 1):
        out = out.join(p.select(*key, F.col("sid").alias(f"_s{i}")), key, "left")
    names = [f"_s{i}" for i in range(len(probes))]
    return out.withColumn("sid", F.coalesce(*names)).drop(*names)


def primary(securities: DataFrame) -> DataFrame:
    """(cik, sid): a company's main security: common first, then the longest span, then the smallest id."""
    rank = first_match([(F.col("category") == "common", "0"), (F.col("category") == "adr", "1")], "2")
    return first_rows(securities.filter("cik is not null"), ["cik"], [rank, F.desc(F.datediff("last", "first")), "sid"]).select("cik", "sid")
