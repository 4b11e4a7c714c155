"""Which listed securities are ordinary shares: the first rule that fits gives the reason to leave one out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.scalars import first_match
from tidewater.operators.reconcile import first_rows

# Name patterns and fifth letters of listings that aren't ordinary shares, and exchanges that count.
NAME_RULES = (
    ("preferred", r"(?i)\b(preferred|preference|depositary shares?,? each representing|pfd)\b"),
    ("warrant", r"(?i)\bwarrants?\b"),
    ("right", r"(?i)\brights?\b"),
    ("unit", r"(?i)\bunits?\b"),
    ("note", r"(?i)(\bnotes? due\b|\b(senior|subordinated) notes?\b|\bdebentures?\b|\d+(\.\d+)?% )"),
    ("fund", r"(?i)\b(fund|etf|etn)\b"),
)
FIFTH_LETTERS = {"W": "warrant", "R": "right", "U": "unit", "P": "preferred", "Q": "bankrupt"}
VENUES = ("NYSE", "NASDAQ", "NYSE MKT", "NYSE ARCA", "BATS", "AMEX")


def normalize(symbol):
    return F.upper(F.trim(F.regexp_replace(symbol, "-", ".")))


def exclude_reason(symbol="symbol", name="name", etf="etf", test="test_issue", exchange: str | None = None):
    """Reason or null, the rules in order: test issue, fund, venue, suffix, fifth letter, name. "Preferred" within a bank's name
    that is a common stock does not count."""
    s, n = F.col(symbol), F.col(name)
    rules = [(F.col(test), "test"), (F.col(etf), "etf")]
    if exchange:
        rules.append((~F.col(exchange).isin(*VENUES), "venue"))
    rules += [(s.rlike(r"(\$|\.(PR|P)[A-Z]?$)"), "preferred"), (s.rlike(r"\.W[S]?$"), "warrant"), (s.rlike(r"\.R[T]?$"), "right"), (s.rlike(r"\.U[N]?$"), "unit")]
    fifth = (F.length(s) == 5) & s.rlike("^[A-Z]{5}$")
    rules += [(fifth & (F.substring(s, 5, 1) == letter), reason) for letter, reason in FIFTH_LETTERS.items()]
    common = n.rlike(r"(?i)\b(common stock|ordinary shares?)\b")
    rules += [(n.rlike(pattern) & (~common if reason in ("preferred", "unit") else F.lit(True)), reason) for reason, pattern in NAME_RULES]
    return first_match(rules)


def classify(listings: DataFrame) -> DataFrame:
    """Listings with ``exclude_reason`` and ``included``; the first row of a symbol by name."""
    out = listings.withColumn("symbol", normalize(F.col("symbol"))).withColumn("exclude_reason", exclude_reason())
    return first_rows(out, ["symbol"], ["name"]).withColumn("included", F.col("exclude_reason").isNull())


def reasons(classified: DataFrame) -> DataFrame:
    return classified.filter("not included").groupBy("exclude_reason").agg(F.count("*").alias("n"))


def dead_stocks(listed: DataFrame, current: DataFrame, first_day, last_day, venues=VENUES) -> DataFrame:
    """Ended listings (symbol, exchange, asset_type, currency, start, end) that were stocks in dollars on a venue and are not listed
    now; ``otc`` marks those that went on over the counter."""
    plain = F.col("symbol").rlike(r"^[A-Z]{1,5}(\.[A-Z])?$") & ~F.col("symbol").rlike(r"^[A-Z]{4}[WRUPQ]$")
    ok = (F.lower("asset_type") == "stock") & (F.col("currency") == "USD") & plain & (F.col("end") >= first_day) & (F.col("end") < last_day)
    keep = listed.filter(ok & (F.col("exchange").isin(*venues) | F.col("exchange").startswith("OTC") | (F.col("exchange") == "PINK")))
    gone = keep.join(current.select("symbol"), "symbol", "left_anti")
    return gone.withColumn("otc", ~F.col("exchange").isin(*venues))


def master(old: DataFrame, seen: DataFrame, day) -> DataFrame:
    """Universe master: first_seen kept, last_seen set for symbols seen on the day, symbols gone kept."""
    now = seen.join(old.select("symbol", F.col("first_seen").alias("_f")), "symbol", "left")
    now = now.withColumn("first_seen", F.coalesce("_f", F.lit(day).cast("date"))).withColumn("last_seen", F.lit(day).cast("date")).drop("_f")
    return now.unionByName(old.join(seen.select("symbol"), "symbol", "left_anti"), allowMissingColumns=True)


def current_symbols(universe: DataFrame) -> DataFrame:
    """Included symbols of the newest day."""
    last = universe.agg(F.max("last_seen").alias("_l"))
    return universe.join(F.broadcast(last), F.col("last_seen") == F.col("_l")).filter("included").select("symbol")
