"""Grading of scores: forward returns, rank correlation, group spreads, bins, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.scalars import bucket, guarded_corr
from tidewater.functions.windows import avg_rank


def forward_returns(market: DataFrame, sessions_ahead: int, haircut: float = -0.30, lost: DataFrame | None = None) -> DataFrame:
    """(date, idx, sid, fwd): compounded return over the next sessions, missing bars counting as nought. Null where the calendar
    ends before. A name in ``lost`` (sid) whose last bar lies inside the window takes the haircut after it."""
    last_idx = market.agg(F.max("idx").alias("_end"))
    w = Window.partitionBy("sid").orderBy("idx").rangeBetween(1, sessions_ahead)
    g = F.coalesce(F.sum(F.log1p(F.coalesce("ret_cc", F.lit(0.0)))).over(w), F.lit(0.0))
    m = market.withColumn("_g", g).withColumn("_last", F.max("idx").over(Window.partitionBy("sid")))
    m = m.crossJoin(F.broadcast(last_idx))  # one row
    fwd = F.exp("_g")
    if lost is not None:
        m = m.join(lost.select("sid", F.lit(True).alias("_lost")), "sid", "left")
        gone = F.coalesce("_lost", F.lit(False)) & (F.col("_last") < F.col("_end")) & (F.col("_last") < F.col("idx") + sessions_ahead)
        fwd = fwd * F.when(gone, 1 + haircut).otherwise(1.0)
    return m.select("date", "idx", "sid", F.when(F.col("idx") + sessions_ahead <= F.col("_end"), fwd - 1).alias("fwd"))


def rank_ic(df: DataFrame, by: list[str], score: str = "score", outcome: str = "fwd", least: int = 20) -> DataFrame:
    """(by, n, ic): Spearman correlation of known pairs with ties at mean rank; groups with fewer pairs or a constant side drop out."""
    known = df.filter(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    ranked = known.withColumn("_a", avg_rank(score, by)).withColumn("_b", avg_rank(outcome, by))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), guarded_corr(F.col("_a"), F.col("_b")).alias("ic")).filter((F.col("n") >= least) & F.col("ic").isNotNull())


def quantile_spread(df: DataFrame, by: list[str], score: str = "score", outcome: str = "fwd", share: float = 0.2, least: int = 20) -> DataFrame:
    """(by, top, bottom): mean outcome at or beyond the score's quantiles (linear), so that ties share a group."""
    known = df.filter(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    edges = known.groupBy(*by).agg(F.percentile(score, F.lit(1 - share)).alias("_hi"), F.percentile(score, F.lit(share)).alias("_lo"), F.count("*").alias("n"), F.min(score).alias("_min"), F.max(score).alias("_max"))
    edges = edges.filter((F.col("n") >= least) & (F.col("_max") > F.col("_min")))
    both = known.join(edges.drop("_min", "_max"), by)
    return both.groupBy(*by).agg(F.avg(F.when(F.col(score) >= F.col("_hi"), F.col(outcome))).alias("top"), F.avg(F.when(F.col(score) <= F.col("_lo"), F.col(outcome))).alias("bottom"))


def decile_spread(df: DataFrame, by: list[str], tie: str, score: str = "score", outcome: str = "fwd") -> DataFrame:
    """(by, n, spread): mean outcome of the best tenth less the worst, by position; at least one row each."""
    known = df.filter(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    w = Window.partitionBy(*by)
    k = F.greatest(F.floor(F.col("_n") / 10), F.lit(1))
    r = known.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(score, tie)))
    return r.groupBy(*by).agg(F.count("*").alias("n"), (F.avg(F.when(F.col("_r") > F.col("_n") - k, F.col(outcome))) - F.avg(F.when(F.col("_r") <= k, F.col(outcome)))).alias("spread"))


def fit_bins(df: DataFrame, by: list[str], tie: str, bins: int = 20, score: str = "score", outcome: str = "fwd", z: float = 1.645) -> DataFrame:
    """(bin, n, mean, q25, q75, margin): outcomes by score rank within each date; the margin is z standard errors of monthly means."""
    known = df.filter(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    w = Window.partitionBy(*by)
    r = known.withColumn("_r", F.row_number().over(w.orderBy(score, tie))).withColumn("_n", F.count("*").over(w))
    binned = r.withColumn("bin", F.floor(F.col("_r") * bins / (F.col("_n") + 1)).cast("long"))
    months = binned.groupBy("bin", *by).agg(F.avg(outcome).alias("_m")).groupBy("bin").agg((z * F.stddev_samp("_m") / F.sqrt(F.count("*"))).alias("margin"))
    stats = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg(outcome).alias("mean"), F.percentile(outcome, F.lit(0.25)).alias("q25"), F.percentile(outcome, F.lit(0.75)).alias("q75"))
    return stats.join(months, "bin")


def summarize(scores: DataFrame, by: list[str], periods: Column, value: str = "ic") -> DataFrame:
    """(by, n, mean, sd, t, hit): of a series of monthly values."""
    s = F.stddev_samp(value)
    return scores.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), s.alias("sd"), F.try_divide(F.avg(value) * F.sqrt(F.count(value)), s).alias("t"), F.avg((F.col(value) > 0).cast("double")).alias("hit"))


def annualised(value: Column, periods_per_year: float) -> Column:
    """Geometric mean growth a year of period returns above -1."""
    return F.exp(F.sum(F.log1p(value)) * periods_per_year / F.count(value)) - 1


def grade_report(df: DataFrame, forecast: str = "score", actual: str = "fwd") -> DataFrame:
    """One row: slope of actual on forecast, on each half of the dates, and R2 against the mean of nought."""
    known = df.filter(F.col(forecast).isNotNull() & F.col(actual).isNotNull())
    middle = known.agg(F.percentile(F.unix_date("date").cast("double"), F.lit(0.5)).alias("_mid"))
    k = known.crossJoin(F.broadcast(middle)).withColumn("_first", F.unix_date("date") <= F.col("_mid"))
    f, a = F.col(forecast), F.col(actual)
    half = lambda cond: F.regr_slope(F.when(cond, a), F.when(cond, f))
    return k.agg(F.count("*").alias("n"), F.regr_slope(a, f).alias("slope"), half(F.col("_first")).alias("slope_first"), half(~F.col("_first")).alias("slope_second"), (1 - F.try_divide(F.avg((a - f) * (a - f)), F.avg(a * a))).alias("r2"))


def conditional_ic(ics: DataFrame, conditions: dict[str, tuple[Column, list[float], list[str]]]) -> DataFrame:
    """(condition, bucket, n, mean, t): a value's statistics by bucket of each condition, in one pass."""
    rows = F.array(*[F.struct(F.lit(n).alias("condition"), bucket(v, e, labels).alias("bucket")) for n, (v, e, labels) in conditions.items()])
    long = ics.select("ic", F.inline(rows)).filter("bucket is not null")
    return long.groupBy("condition", "bucket").agg(F.count("ic").alias("n"), F.avg("ic").alias("mean"), F.try_divide(F.avg("ic") * F.sqrt(F.count("ic")), F.stddev_samp("ic")).alias("t"))


def tenths(df: DataFrame, by: list[str], tie: str, score: str = "score") -> DataFrame:
    """Adds ``tenth``: top (ordinal rank share over 0.9), bottom (at most 0.1) or null."""
    w = Window.partitionBy(*by)
    share = F.row_number().over(w.orderBy(F.asc_nulls_first(score), tie)) / F.count("*").over(w)
    return df.withColumn("_s", share).withColumn("tenth", F.when(F.col("_s") > 0.9, "top").when(F.col("_s") <= 0.1, "bottom")).drop("_s")


def evaluate(market: DataFrame, scores: DataFrame, decide: Column, pools: dict[str, int | None], horizons: list[int], least: int = 20, liquidity: str = "adv") -> DataFrame:
    """(pool, horizon, date, n, ic, top, bottom) for every decision date at once: scores (date, sid, score) of the pool's most liquid
    names against forward returns, dates with a complete forward window only."""
    out = None
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.desc_nulls_last(liquidity), "sid"))
    ranked = market.filter(decide).withColumn("_r", rank).select("date", "sid", "_r", liquidity)
    for h in horizons:
        fwd = forward_returns(market, h).filter("fwd is not null").select("date", "sid", "fwd")
        joined = ranked.join(scores, ["date", "sid"]).join(fwd, ["date", "sid"])
        for name, size in pools.items():
            rows = joined if size is None else joined.filter((F.col("_r") <= size) & F.col(liquidity).isNotNull())
            part = rank_ic(rows, ["date"], least=least).join(quantile_spread(rows, ["date"], least=least), "date")
            part = part.select(F.lit(name).alias("pool"), F.lit(h).cast("long").alias("horizon"), "date", "n", "ic", "top", "bottom")
            out = part if out is None else out.unionByName(part)
    return out


def refresh_scores(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows of other signals, and the fresh ones."""
    return stored.join(fresh.select("signal").distinct(), "signal", "left_anti").unionByName(fresh)


def trailing_mean(ics: DataFrame, n: int = 12, value: str = "ic") -> DataFrame:
    """(date, trailing): mean of the last ``n`` values, null before there are as many."""
    w = Window.orderBy("date").rowsBetween(-(n - 1), 0)  # one row a month
    return ics.select("date", F.when(F.count(value).over(w) == n, F.avg(value).over(w)).alias("trailing"))


def liquid_grades(df: DataFrame, tie: str, pool: int = 400, top: int = 30, score: str = "score", outcome: str = "fwd", liquidity: str = "adv") -> DataFrame:
    """(date, ic, top_mean): within the most liquid names of a date, rank correlation and the mean outcome of the best scores."""
    w = Window.partitionBy("date")
    r = df.withColumn("_l", F.row_number().over(w.orderBy(F.desc_nulls_last(liquidity), tie))).filter((F.col("_l") <= pool) & F.col(liquidity).isNotNull() & F.col(score).isNotNull() & F.col(outcome).isNotNull())
    best = r.withColumn("_k", F.row_number().over(w.orderBy(F.desc(score), tie))).filter(F.col("_k") <= top).groupBy("date").agg(F.avg(outcome).alias("top_mean"))
    return rank_ic(r, ["date"], score, outcome, 2).select("date", "ic").join(best, "date")


def caution_dial(env: DataFrame, forward: DataFrame, conditions: dict[str, tuple[Column, list[float], list[str]]]) -> DataFrame:
    """(condition, bucket, n, ret, vol, drawdown, worst): what followed each bucket. env: a row a date; forward: (date, fwd_ret, fwd_vol, fwd_dd)."""
    rows = F.array(*[F.struct(F.lit(n).alias("condition"), bucket(v, e, labels).alias("bucket")) for n, (v, e, labels) in conditions.items()])
    long = env.join(forward.filter("fwd_ret is not null"), "date").select("fwd_ret", "fwd_vol", "fwd_dd", F.inline(rows)).filter("bucket is not null")
    return long.groupBy("condition", "bucket").agg(F.count("*").alias("n"), F.avg("fwd_ret").alias("ret"), F.avg("fwd_vol").alias("vol"), F.avg("fwd_dd").alias("drawdown"), F.min("fwd_dd").alias("worst"))
