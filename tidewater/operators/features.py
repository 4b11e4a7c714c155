"""Derived tables: daily liquidity, the monthly feature panel, prior-year pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.scalars import ratio
from tidewater.functions.windows import pct_rank
from tidewater.operators.asof import asof_backward, asof_nearest
from tidewater.operators.intervals import in_any
from tidewater.operators.prices import eligible, liquidity
from tidewater.operators.signals import calendar_month_momentum, price_features

# Days a filing stays usable, days around the year before, least names of an industry rank.
FILING_AGE, PRIOR_TOLERANCE, INDUSTRY_LEAST = 550, 20, 5


def daily_table(bars: DataFrame, listings: DataFrame, window: int = 60, least: int = 30) -> DataFrame:
    """(sid, date, close, adv, bars_seen, traded, common): one shuffle by sid serves the median, the count and the return."""
    common = listings.filter(F.col("category") == "common").select("sid", "from", "to")
    d = liquidity(bars, window=window, least=least).withColumn("traded", F.coalesce(F.col("volume") > 0, F.lit(False)))
    return in_any(d, common, "sid", "date", "common")


def market_table(bars: DataFrame, daily: DataFrame, calendar: DataFrame, **limits) -> DataFrame:
    """Bars with liquidity, session index and eligibility: the long form of a panel."""
    d = daily.select("sid", "date", "adv", "bars_seen", "traded", "common")
    c = calendar.select("date", F.col("idx").cast("long").alias("idx"), "month_end")
    out = bars.join(d, ["sid", "date"]).join(F.broadcast(c), "date")  # a row a day
    return out.withColumn("eligible", eligible(traded="traded", common="common", **limits))


def with_prior(states: DataFrame, columns: list[str], key: str = "sid") -> DataFrame:
    """Annual states with the state a year before (``prior_``), nearest within the tolerance, unless that was filed later."""
    left = states.withColumn("_want", F.date_sub("period_end", 365))
    # The prior year's own end lies a year before; looked for from its end plus 365 days.
    out = asof_nearest(left, states.select(key, F.col("period_end").alias("_pe"), F.col("filed").alias("_pf"), *[F.col(c).alias(f"prior_{c}") for c in columns]), [key], "_want", "_pe", ["_pf", *[f"prior_{c}" for c in columns]], PRIOR_TOLERANCE, row_key=[key, "filed", "period_end"])
    late = F.coalesce(F.col("_pf") > F.col("filed"), F.lit(True))
    return out.withColumns({f"prior_{c}": F.when(~late, F.col(f"prior_{c}")) for c in columns}).drop("_want", "_pf")


def filing_values(states: DataFrame, market: DataFrame) -> DataFrame:
    """States with ``filed_value`` (shares times the last close at or before filing) and the log growth ``filed_log`` of that day."""
    log = F.sum(F.log1p(F.coalesce("ret_cc", F.lit(0.0)))).over(Window.partitionBy("sid").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    prices = market.select("sid", F.col("date").alias("_d"), F.col("close").alias("_c"), log.alias("_l"))
    out = asof_backward(states, prices, ["sid"], "filed", "_d", ["_c", "_l"])
    return out.withColumn("filed_value", F.col("shares_out") * F.col("_c")).withColumnRenamed("_l", "filed_log").drop("_c")


RATIOS = {
    "earnings_yield": ("net_income", "market_value"),
    "sales_yield": ("revenue", "market_value"),
    "book_to_market": ("equity", "market_value"),
    "cfo_to_assets": ("cfo", "assets"),
    "roa": ("net_income", "assets"),
    "asset_turnover": ("revenue", "assets"),
    "rd_mve": ("rnd", "market_value"),
    "leverage": ("lt_debt", "assets"),
    "current_ratio": ("assets_cur", "liab_cur"),
}


def monthly_features(market: DataFrame, states: DataFrame, industry: DataFrame | None = None, window: int = 252, month: int = 21, ranked: list[str] = ("earnings_yield", "roa")) -> DataFrame:
    """A row a month end and eligible name with ``window`` sessions of history: price features, the newest filing strictly before
    (not older than FILING_AGE days), market value carried by total return since filing, ratios, and ranks within the industry."""
    log = F.sum(F.log1p(F.coalesce("ret_cc", F.lit(0.0)))).over(Window.partitionBy("sid").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    grid = market.withColumn("_log", log).filter(F.col("month_end") & F.col("eligible") & (F.col("idx") >= window)).select("date", "sid", "adv", "close", "_log")
    grid = grid.join(price_features(market, window, month), ["date", "sid"])
    grid = grid.withColumn("_m", F.trunc("date", "month")).join(calendar_month_momentum(market).withColumnRenamed("month", "_m"), ["_m", "sid"], "left").drop("_m")
    columns = sorted({c for pair in RATIOS.values() for c in pair if c != "market_value" and c in states.columns})
    valued = filing_values(states, market)
    out = asof_backward(grid, valued, ["sid"], "date", "filed", ["filed", "period_end", "filed_value", "filed_log", *columns], strict=True, tiebreak=["period_end"], max_age_days=FILING_AGE)
    out = out.withColumn("market_value", F.col("filed_value") * F.exp(F.col("_log") - F.col("filed_log"))).drop("_log", "filed_log", "filed_value")
    out = out.withColumns({n: ratio(a, b) for n, (a, b) in RATIOS.items() if a in columns and (b == "market_value" or b in columns)})
    if industry is not None:
        out = out.join(F.broadcast(industry.select("sid", "sic2")) if industry.count() <= 1_000_000 else industry.select("sid", "sic2"), "sid", "left")
        for c in ranked:
            out = out.withColumn(f"{c}_ind", F.when(F.col("sic2").isNotNull(), pct_rank(c, ["date", "sic2"], INDUSTRY_LEAST)))
    return out
