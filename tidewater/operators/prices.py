"""Daily bars: returns, split undo, liquidity, eligibility, row validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.windows import rolling_median

# The rounding slack of highs and lows, and the bounds of a believable daily return.
OHLC_SLACK, RETURN_LOW, RETURN_HIGH = 1e-6, -0.95, 10.0


def daily_returns(bars: DataFrame, key: str = "sid", date: str = "date") -> DataFrame:
    """``ret_cc`` and, with an ``open`` column, ``ret_co``: against the previous close of the key; null on its first bar."""
    before = F.lag("close").over(Window.partitionBy(key).orderBy(date))
    out = bars.withColumn("_before", before).withColumn("ret_cc", F.when(F.col("_before") > 0, F.col("close") / F.col("_before") - 1))
    if "open" in bars.columns:
        out = out.withColumn("ret_co", F.when(F.col("_before") > 0, F.col("open") / F.col("_before") - 1))
    return out.drop("_before")


def undo_splits(bars: DataFrame, key: str = "sid", date: str = "date") -> DataFrame:
    """From split-adjusted prices and ``closeunadj``: prices as traded, volume likewise, returns from adjusted ``closeadj``."""
    w = Window.partitionBy(key).orderBy(date)
    factor = F.col("closeunadj") / F.col("close")
    out = bars.filter("close > 0").withColumn("_f", factor).withColumn("_before", F.lag("closeadj").over(w))
    out = out.withColumn("ret_cc", F.when(F.col("_before") > 0, F.col("closeadj") / F.col("_before") - 1))
    out = out.withColumn("ret_co", F.when(F.col("_before") > 0, F.col("closeadj") * F.col("open") / F.col("close") / F.col("_before") - 1))
    for c in ("open", "high", "low", "close"):
        out = out.withColumn(f"{c}_raw", F.col(c) * F.col("_f"))
    return out.withColumn("volume_raw", F.col("volume") / F.col("_f")).drop("_f", "_before")


def liquidity(bars: DataFrame, key: str = "sid", date: str = "date", window: int = 60, least: int = 30) -> DataFrame:
    """``adv``: median traded value of the last ``window`` bars; ``bars_seen``: bars so far."""
    w = Window.partitionBy(key).orderBy(date)
    value = bars.withColumn("_value", F.col("close") * F.col("volume"))
    return value.withColumn("adv", rolling_median("_value", key, date, window, least)).withColumn("bars_seen", F.row_number().over(w)).drop("_value")


def eligible(close="close", adv="adv", seen="bars_seen", traded=None, common=None, min_price: float = 5.0, min_adv: float = 1e6, min_bars: int = 252):
    """Whether a bar may be held; anything unknown counts as no."""
    out = (F.col(close) > min_price) & (F.col(adv) > min_adv) & (F.col(seen) >= min_bars)
    for flag in (traded, common):
        if flag is not None:
            out = out & F.col(flag)
    return F.coalesce(out, F.lit(False))


def ever_eligible(market: DataFrame, key: str = "sid", flag: str = "eligible") -> DataFrame:
    """Rows of entities that qualify on any day (a look-ahead view, for research)."""
    return market.join(market.filter(flag).select(key).distinct(), key, "left_semi")


def validate(bars: DataFrame, sessions: DataFrame, key: str = "sid", date: str = "date", arrival: str = "arrival") -> DataFrame:
    """Rows that pass: last arrival of a key and day, session days only, prices in order; impossible returns become null."""
    w = Window.partitionBy(key, date).orderBy(F.desc(arrival))
    one = bars.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    on = one.join(F.broadcast(sessions.select(F.col(date))), date, "left_semi")
    slack = F.lit(1 + OHLC_SLACK)
    ordered = (F.col("high") * slack >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close", "high") * slack) & (F.col("low") > 0)
    ret = F.when((F.col("ret_cc") > RETURN_LOW) & (F.col("ret_cc") < RETURN_HIGH), F.col("ret_cc"))
    return on.filter(ordered).withColumn("ret_cc", ret)


def drop_first_overlap(fresh: DataFrame, stored: DataFrame, key: str = "sid", date: str = "date") -> DataFrame:
    """Fresh rows without those that have no return only because the fetch began there and that are stored already."""
    last = stored.groupBy(key).agg(F.max(date).alias("_last"))
    known = F.coalesce(F.col(date) <= F.col("_last"), F.lit(False))
    return fresh.join(last, key, "left").filter(~(F.col("ret_cc").isNull() & known)).drop("_last")


def plan_fetches(symbols: DataFrame, extent: DataFrame, today, recent_days: int = 20, key: str = "sid") -> DataFrame:
    """``symbols`` with what to fetch: fresh (nothing stored), recent (stored lately) or stale."""
    gap = F.datediff(F.lit(today).cast("date"), F.col("last"))
    plan = F.when(F.col("last").isNull(), "fresh").when(gap <= recent_days, "recent").otherwise("stale")
    return symbols.join(extent.select(key, "first", "last"), key, "left").withColumn("plan", plan)


def drift(stored: DataFrame, fresh: DataFrame, tolerance: float = 1e-4, key: str = "sid", date: str = "date", ret: str = "ret_cc") -> DataFrame:
    """(key, worst): entities whose stored and fresh returns differ by more than the tolerance on a common day."""
    b = fresh.select(key, date, F.col(ret).alias("_fresh"))
    return stored.join(b, [key, date]).groupBy(key).agg(F.max(F.abs(F.col(ret) - F.col("_fresh"))).alias("worst")).filter(F.col("worst") > tolerance)


def implied_yield(low: float = -0.05, high: float = 0.25):
    """Dividend yield of a day that total and price return imply, where believable."""
    before = F.lag("close").over(Window.partitionBy("sid").orderBy("date"))
    y = (1 + F.col("ret_cc")) * before / F.col("close") - 1
    return F.when((y > low) & (y < high), y)
