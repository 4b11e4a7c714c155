"""From each vendor's tables to the shared ones: resolve names to ids, number new listings, keep one row a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.scalars import first_match
from tidewater.operators.asof import asof_backward
from tidewater.operators.ids import Ids, extend, resolve
from tidewater.operators.intervals import covering, lookup
from tidewater.operators.reconcile import first_rows, later_product

# A directory's exchange codes, its reasons as categories, a vendor's dimensions as periods.
EXCHANGES = {"Q": "NASDAQ", "N": "NYSE", "A": "NYSEMKT", "P": "NYSEARCA", "Z": "BATS"}
REASONS = {"etf": "etf", "fund": "cef", "preferred": "preferred", "unit": "unit", "warrant": "warrant", "right": "right"}
PERIODS = {"ART": "ttm", "ARQ": "q"}


def exchange_name(code):
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in EXCHANGES.items() for x in pair]), code), code)


def by_span(ids: Ids, bars: DataFrame) -> DataFrame:
    """``bars`` (ticker, date, ...) with ``sid``: whose name it is on the ticker's last bar, else on its first, else midway."""
    span = bars.groupBy("ticker").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    middle = F.date_add("_a", F.floor(F.datediff("_b", "_a") / 2).cast("int"))
    probes = [lookup(ids.names, span.select("ticker", d.alias("date"))).select("ticker", "sid") for d in (F.col("_b"), F.col("_a"), middle)]
    return bars.join(resolve(probes, ["ticker"]), "ticker", "left")


def one_per_day(ids: Ids, rows: DataFrame) -> DataFrame:
    """One row a sid and day: the ticker that is its name that day, else the one that traded last, else the first by name."""
    named = lookup(ids.names, rows.select("ticker", "date").distinct()).withColumnRenamed("sid", "_named")
    last = rows.groupBy("ticker").agg(F.max("date").alias("_last"))
    both = rows.join(named, ["ticker", "date"], "left").join(last, "ticker")
    order = [F.coalesce(F.col("_named") == F.col("sid"), F.lit(False)).desc(), F.desc("_last"), F.col("ticker")]
    return first_rows(both, ["sid", "date"], order).drop("_named", "_last")


def bars_with_ids(ids: Ids, bars: DataFrame, symbols: DataFrame, known_until) -> tuple[Ids, DataFrame]:
    """(ids, prices): a ticker that nobody holds on any day it traded and that began after the ids' history is a new listing;
    rows that stay without an id drop out. symbols: (ticker, name, exchange, category)."""
    found = by_span(ids, bars)
    lone = found.groupBy("ticker").agg(F.count("sid").alias("_n"), F.min("date").alias("date"), F.max("date").alias("until")).filter("_n = 0")
    free = covering(ids.names, lone, until="until").filter((F.col("covering") == 0) & (F.col("date") > F.lit(known_until)))
    new = free.select("ticker", F.col("date").alias("first")).join(symbols, "ticker", "left")
    if new.take(1):
        ids = extend(ids, new)
        found = by_span(ids, bars)
    return ids, one_per_day(ids, found.filter("sid is not null"))


def directory_listings(ids: Ids, symbols: DataFrame) -> tuple[Ids, DataFrame]:
    """(ids, listings): directory rows (ticker, name, exchange, first_seen, last_seen, exclude_reason) resolved on their last day.
    Only ordinary shares and funds that nobody held on any day seen are new. A kind that the ids know wins over the directory's."""
    newest = symbols.agg(F.max("last_seen").alias("_newest"))
    kind = first_match([(F.col("exclude_reason").isNull(), "common"), *[(F.col("exclude_reason") == k, v) for k, v in REASONS.items()]], "other")
    s = symbols.withColumn("category", kind).crossJoin(F.broadcast(newest))  # one row
    gone = F.when(F.col("last_seen") < F.col("_newest"), F.col("last_seen"))
    held = covering(ids.names, s.withColumn("date", F.col("first_seen")), until="last_seen")
    new = held.filter((F.col("covering") == 0) & F.col("category").isin("common", "etf")).select("ticker", "name", "exchange", "category", F.col("first_seen").alias("first"))
    if new.take(1):
        ids = extend(ids, new)
    found = lookup(ids.names, s.withColumn("date", F.col("last_seen"))).filter("sid is not null")
    one = first_rows(found, ["sid", "first_seen"], [(F.col("category") != "common").cast("int"), F.col("ticker")])
    kinds = ids.securities.select("sid", F.col("category").alias("_kind"))
    out = one.join(kinds, "sid", "left").select("sid", F.col("first_seen").alias("from"), gone.alias("to"), "exchange", F.coalesce("_kind", "category").alias("category"))
    return ids, out


def delisting_actions(ids: Ids, dead: DataFrame) -> DataFrame:
    """(sid, date, action): ended listings (ticker, start, end, otc) by their name on the last day, else on the first."""
    ends = lookup(ids.names, dead.select("ticker", F.col("end").alias("date"))).select("ticker", F.col("date").alias("end"), "sid").distinct()
    starts = lookup(ids.names, dead.select("ticker", F.col("start").alias("date"))).select("ticker", F.col("date").alias("start"), F.col("sid").alias("_s")).distinct()
    found = dead.join(ends, ["ticker", "end"], "left").join(starts, ["ticker", "start"], "left").withColumn("sid", F.coalesce("sid", "_s")).filter("sid is not null")
    done = found.select("sid", F.col("end").alias("date"), F.lit("delisted").alias("action"))
    return done.unionByName(found.filter("otc").select("sid", F.col("end").alias("date"), F.lit("otc").alias("action")))


def mapped_ids(keys: DataFrame, maps: DataFrame, today: DataFrame, names: DataFrame) -> DataFrame:
    """``keys`` (ticker, asof) with ``sid``: by the newest kept map (ticker, day, sid) at or before, else today's (ticker, sid), else the
    dated name."""
    by_map = asof_backward(keys.select("ticker", "asof").distinct(), maps, ["ticker"], "asof", "day", ["sid"], suffix="_map")
    dated = lookup(names, keys.select("ticker", F.col("asof").alias("date")).distinct()).select("ticker", F.col("date").alias("asof"), F.col("sid").alias("sid_dated"))
    both = by_map.join(today.select("ticker", F.col("sid").alias("sid_today")), "ticker", "left").join(dated, ["ticker", "asof"], "left")
    return keys.join(both.select("ticker", "asof", F.coalesce("sid_map", "sid_today", "sid_dated").alias("sid")), ["ticker", "asof"], "left")


def price_versions(bulk: DataFrame, updates: DataFrame) -> DataFrame:
    """One row a ticker and day: the newest update (lastupdated, then pull), the bulk's only where there is no update."""
    newest = first_rows(updates, ["ticker", "date"], [F.desc("lastupdated"), F.desc("pull")])
    rest = bulk.join(newest.select("ticker", "date"), ["ticker", "date"], "left_anti")
    return newest.unionByName(rest, allowMissingColumns=True)


def vendor_filings(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """As-reported rows (sid, filed, period_end, dimension, fiscalperiod, lastupdated, asof, shares_out, ...): one version a key, with the
    share count as it was at filing, undone by splits (sid, date, value) between filing and the pull."""
    period = F.element_at(F.create_map(*[F.lit(x) for pair in PERIODS.items() for x in pair]), F.col("dimension"))
    r = rows.filter(F.col("dimension").isin(*PERIODS)).withColumn("period", period)
    r = r.withColumn("form", F.when(F.col("fiscalperiod").endswith("Q4"), "10-K").otherwise("10-Q"))
    key = ["sid", "filed", "period_end", "period"]
    one = first_rows(r, key, [F.desc("lastupdated"), F.desc("asof")])
    e = splits.select("sid", F.col("date").alias("split_date"), "value")
    out = later_product(one, e, "sid", "filed", "split_date", "value", until=F.col("asof"), row_key=[*key, "asof"])
    return out.withColumn("shares_out", F.col("shares_out") / F.col("factor")).drop("factor", "dimension", "fiscalperiod")


def company_filings(states: DataFrame, primary: DataFrame) -> DataFrame:
    """Filing states of companies under their main security, trailing-year rows, the most complete of a key."""
    from tidewater.operators.filings import CONCEPTS

    known = sum((F.col(c).isNotNull().cast("int") for c in CONCEPTS if c in states.columns), F.lit(0))
    rows = states.join(primary, "cik").withColumn("period", F.lit("ttm")).withColumn("_k", known)
    return first_rows(rows, ["sid", "filed", "period_end", "period"], [F.desc("_k"), F.desc("accn")]).drop("_k", "cik", "accn")


def price_update(fresh: DataFrame, stored: DataFrame, sessions: DataFrame) -> DataFrame:
    """What a nightly fetch adds: returns against the fetch's own previous bar, first overlap rows dropped, rows checked."""
    from tidewater.operators.prices import daily_returns, drop_first_overlap, validate

    rows = daily_returns(fresh)
    return validate(drop_first_overlap(rows, stored), sessions)


def backfill_candidates(dead: DataFrame, tried: DataFrame) -> DataFrame:
    """Ended listings whose prices were never fetched; such histories do not grow."""
    return dead.join(tried.select("symbol").distinct(), "symbol", "left_anti")
