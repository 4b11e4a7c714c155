"""Signals and strategies: functions of a long market table that give (date, sid, score) or weights for all dates at once.

A market table has sid, date, close, ret_cc, adv and the session index idx. Session windows are RANGE frames on idx, so a
missing bar adds nothing and coverage is the count of known returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.windows import avg_rank
from tidewater.operators.reconcile import first_rows

SIGNALS: dict[str, Callable] = {}
STRATEGIES: dict[str, Callable] = {}


def _register(table: dict[str, Callable], name: str):
    def put(f):
        if name in table:
            raise ValueError(f"{name} is registered already")
        table[name] = f
        return f

    return put


def signal(name: str):
    return _register(SIGNALS, name)


def strategy(name: str):
    return _register(STRATEGIES, name)


def create(table: dict[str, Callable], name: str, **params) -> Callable:
    """The registered function with its parameters bound; KeyError if unknown."""
    f = table[name]
    return lambda *a: f(*a, **params)


def frame(first: int, last: int = 0):
    return Window.partitionBy("sid").orderBy("idx").rangeBetween(first, last)


def log_growth() -> Column:
    """Log of compounded growth so far; a missing return counts as nought."""
    return F.sum(F.log1p(F.coalesce("ret_cc", F.lit(0.0)))).over(Window.partitionBy("sid").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))


@signal("momentum")
def momentum(market: DataFrame, lookback: int = 252, skip: int = 21) -> DataFrame:
    """Growth from ``lookback`` to ``skip`` sessions ago; needs a bar exactly at the window's first session."""
    at_start = F.count("*").over(frame(-lookback, -lookback))
    total = F.sum(F.log1p(F.coalesce("ret_cc", F.lit(0.0)))).over(frame(-(lookback - 1), -skip))
    return market.select("date", "sid", F.when(at_start > 0, F.expm1(F.coalesce(total, F.lit(0.0)))).alias("score")).filter("score is not null")


@signal("reversal")
def reversal(market: DataFrame, lookback: int = 21) -> DataFrame:
    """Minus the growth of the last ``lookback`` sessions."""
    total = F.sum(F.log1p(F.coalesce("ret_cc", F.lit(0.0)))).over(frame(-(lookback - 1)))
    return market.select("date", "sid", (-F.expm1(total)).alias("score"))


@signal("low_vol")
def low_vol(market: DataFrame, lookback: int = 252, coverage: float = 0.8) -> DataFrame:
    """Minus the sample standard deviation of the window's returns where enough are known."""
    w = frame(-(lookback - 1))
    return market.select("date", "sid", F.when(F.count("ret_cc").over(w) >= coverage * lookback, -F.stddev_samp("ret_cc").over(w)).alias("score")).filter("score is not null")


@signal("feature")
def feature(features: DataFrame, column: str, sign: float = 1.0) -> DataFrame:
    """A stored feature as a score."""
    return features.select("date", "sid", (F.col(column) * sign).alias("score")).filter("score is not null")


def price_features(market: DataFrame, window: int = 252, month: int = 21, coverage: float = 0.8) -> DataFrame:
    """(date, sid, mom12, mom1, vol, beta): trailing growth without the last month, last month's, population spread, and beta
    against the market's mean return, where enough of the window's returns are known. A missing return counts as nought in beta."""
    mkt = F.avg("ret_cc").over(Window.partitionBy("idx"))
    m = market.withColumn("_m", mkt).withColumn("_r", F.coalesce("ret_cc", F.lit(0.0)))
    w = frame(-(window - 1))
    lg = F.log1p("_r")
    enough = F.count("ret_cc").over(w) >= coverage * window
    return m.select(
        "date",
        "sid",
        F.when(enough, F.expm1(F.coalesce(F.sum(lg).over(frame(-(window - 1), -month)), F.lit(0.0)))).alias("mom12"),
        F.when(enough, F.expm1(F.sum(lg).over(frame(-(month - 1))))).alias("mom1"),
        F.when(enough, F.stddev_pop("ret_cc").over(w)).alias("vol"),
        F.when(enough, F.try_divide(F.covar_pop("_r", "_m").over(w), F.var_pop("_m").over(w))).alias("beta"),
    )


def calendar_month_momentum(market: DataFrame, first: int = 5, last: int = 1) -> DataFrame:
    """(month, sid, mom6m): growth over the calendar months ``first`` to ``last`` before; null where a month has no bar."""
    monthly = market.groupBy("sid", F.trunc("date", "month").alias("month")).agg(F.sum(F.log1p(F.coalesce("ret_cc", F.lit(0.0)))).alias("g"))
    n = F.year("month") * 12 + F.month("month")
    w = Window.partitionBy("sid").orderBy("_n").rangeBetween(-first, -last)
    out = monthly.withColumn("_n", n)
    return out.select("month", "sid", F.when(F.count("g").over(w) == first - last + 1, F.expm1(F.sum("g").over(w))).alias("mom6m"))


def top_liquid(market: DataFrame, n: int, by: str = "adv") -> DataFrame:
    """The ``n`` rows of each date with the largest ``by``, ties by sid; unknown values never."""
    return first_rows(market.filter(F.col(by).isNotNull() & ~F.isnan(by)), ["date"], [F.desc(by), "sid"], n)


def top_equal(scores: DataFrame, k: int) -> DataFrame:
    """(date, sid, score, weight): the ``k`` best scores of each date at equal weights, ties by sid."""
    best = first_rows(scores, ["date"], [F.desc("score"), "sid"], k)
    return best.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("date")))


@strategy("equal_weight")
def equal_weight(market: DataFrame, n: int = 100) -> DataFrame:
    best = top_liquid(market, n)
    return best.select("date", "sid", (1.0 / F.count("*").over(Window.partitionBy("date"))).alias("weight"))


@strategy("buy_hold")
def buy_hold(market: DataFrame, sid: int) -> DataFrame:
    return market.filter(F.col("sid") == sid).select("date", "sid", F.lit(1.0).alias("weight"))


@strategy("momentum")
def momentum_portfolio(market: DataFrame, pool: int = 100, hold: int = 20, lookback: int = 252, skip: int = 21, decide: Column | None = None) -> DataFrame:
    """Equal weights in the best momentum of the most liquid names, on decision dates."""
    scored = momentum(market, lookback, skip)
    dates = market.filter(decide) if decide is not None else market
    return top_equal(top_liquid(dates, pool).select("date", "sid").join(scored, ["date", "sid"]), hold)


@strategy("piotroski")
def piotroski(market: DataFrame, scores: DataFrame, pool: int = 500, least: int = 8) -> DataFrame:
    """Equal weights in the liquid names whose F-score is at least ``least``."""
    best = top_liquid(market, pool).select("date", "sid").join(scores, ["date", "sid"]).filter(F.col("fscore") >= least)
    return best.select("date", "sid", (1.0 / F.count("*").over(Window.partitionBy("date"))).alias("weight"))


def composed(scores: DataFrame, construct: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A strategy out of a signal's scores and a rule that makes weights of them."""
    return construct(scores)


def fade(rank, full: float, none: float) -> Column:
    """1 up to rank ``full``, falling in a line to 0 at ``none``."""
    r = F.col(rank) if isinstance(rank, str) else rank
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(none) - r) / F.lit(none - full)))


def soft_weights(scores: DataFrame, pools: list[int], tops: list[int], liquidity: str = "adv") -> DataFrame:
    """(date, sid, share): over all pairs of pool size and holding size, the share of selections that hold the name."""
    liq = F.row_number().over(Window.partitionBy("date").orderBy(F.desc_nulls_last(liquidity), "sid"))
    ranked = scores.withColumn("_liq", liq)
    picks = None
    for p in pools:
        inside = ranked.filter(F.col("_liq") <= p).withColumn("_r", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"), "sid")))
        n = sum((F.when(F.col("_r") <= t, 1).otherwise(0) for t in tops), F.lit(0))
        part = inside.select("date", "sid", n.alias("n"))
        picks = part if picks is None else picks.unionByName(part)
    return picks.groupBy("date", "sid").agg((F.sum("n") / float(len(pools) * len(tops))).alias("share")).filter("share > 0")


def sticky_sets(ranks: DataFrame, enter: int, leave: int) -> DataFrame:
    """(date, sid): a name enters at rank ``enter`` or better and stays until its rank is worse than ``leave`` or missing.

    Per name a running fold: the last event, entering or leaving, decides. A missing date between is a leave."""
    w = Window.partitionBy("sid").orderBy("idx")
    gap = F.coalesce(F.col("idx") - F.lag("idx").over(w) > 1, F.lit(True))
    event = F.when(F.col("rank") <= enter, 1).when((F.col("rank") > leave) | gap, 0)
    held = F.last(event, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ranks.withColumn("_h", held).filter("_h = 1").select("date", "sid")


def healthy(scores: DataFrame, share: float) -> DataFrame:
    """The best ``share`` of each date's scores, count rounded half to even."""
    w = Window.partitionBy("date")
    ranked = scores.withColumn("_r", F.row_number().over(w.orderBy(F.desc("score"), "sid"))).withColumn("_n", F.count("*").over(w))
    return ranked.filter(F.col("_r") <= F.bround(F.col("_n") * share)).drop("_r", "_n")


def contrarian_returns(market: DataFrame, rf: float, premium: float = 0.08, strength: float = 0.10) -> DataFrame:
    """Expected return: rf + premium + strength * vol * z, z the date's standardised rank of the reversal score."""
    z = (avg_rank("score", ["date"]) - (F.count("score").over(Window.partitionBy("date")) + 1) / 2.0) / F.stddev_pop("score").over(Window.partitionBy("date"))
    return market.withColumn("expected", rf + premium + strength * F.col("vol") * z)


def check_weights(weights: DataFrame, allowed: DataFrame | None = None) -> None:
    """Raises unless weights are finite, not negative, sum to at most 1 a date and only hold allowed names."""
    bad = weights.filter(F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") < 0) | (F.col("weight") > 1 + 1e-9)).take(1)
    over = weights.groupBy("date").agg(F.sum("weight").alias("s")).filter(F.col("s") > 1 + 1e-9).take(1)
    alien = weights.join(allowed, ["date", "sid"], "left_anti").take(1) if allowed is not None else []
    if bad or over or alien:
        raise ValueError(f"weights break a rule: {bad or over or alien}")
