"""Mean-variance weights in numpy, one small problem a date, solved in grouped maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidewater.functions.spread import by_key

# Largest weight, weight below which a name is dropped, L2 penalty, objectives.
CAP, CUTOFF, L2 = 0.10, 1e-4, 0.1
OBJECTIVES = ("max_sharpe", "min_volatility", "max_quadratic_utility", "kelly")


def shrunk_covariance(x: np.ndarray, periods: int = 252) -> np.ndarray:
    """Ledoit-Wolf (2004) shrinkage of the sample covariance to a multiple of the identity, annualised. Rows are days."""
    x = x - x.mean(axis=0)
    n, p = x.shape
    s = x.T @ x / n
    mean = np.trace(s) / p
    spread = ((s - mean * np.eye(p)) ** 2).sum() / p
    noise = (((x**2).T @ (x**2)).sum() / n - (s**2).sum()) / (n * p)
    share = 1.0 if spread == 0 else min(max(noise, 0.0) / spread, 1.0)
    return ((1 - share) * s + share * mean * np.eye(p)) * periods


def project(v: np.ndarray, cap: float) -> np.ndarray:
    """The nearest weights in [0, cap] that sum to one, by bisection on the shift."""
    low, high = v.min() - cap, v.max()
    for _ in range(100):
        mid = (low + high) / 2
        if np.clip(v - mid, 0, cap).sum() > 1:
            low = mid
        else:
            high = mid
    return np.clip(v - (low + high) / 2, 0, cap)


def quadratic(cov: np.ndarray, gain: np.ndarray, cap: float, start: np.ndarray | None = None, steps: int = 3000) -> np.ndarray:
    """argmin 1/2 w'cov w - gain'w over the capped simplex, by accelerated projected gradients with restarts."""
    n = len(gain)
    w = np.full(n, 1 / n) if start is None else start
    rate = 1 / max(np.linalg.eigvalsh(cov)[-1], 1e-12)
    y, t = w, 1.0
    for _ in range(steps):
        new = project(y - rate * (cov @ y - gain), cap)
        if np.abs(new - w).max() < 1e-10:
            return new
        if (y - new) @ (new - w) > 0:
            y, t = w, 1.0
            continue
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, w, t = new + (t - 1) / nt * (new - w), new, nt
    return w


def solve(mu: np.ndarray, cov: np.ndarray, objective: str, rf: float = 0.0, cap: float = CAP, risk_aversion: float = 1.0, l2: float = L2) -> np.ndarray:
    """Weights of an objective; the cap is at least 1/n. A Sharpe ratio without any return over rf falls back to least volatility."""
    if objective not in OBJECTIVES:
        raise ValueError(f"unknown objective {objective}")
    n = len(mu)
    cap = max(cap, 1 / n)
    if objective == "kelly":
        return quadratic(cov, mu - rf, cap)
    if objective == "max_quadratic_utility":
        return quadratic(risk_aversion * cov + 2 * l2 * np.eye(n), mu, cap)
    if objective == "max_sharpe" and (mu > rf).any():
        extra = mu - rf
        w = quadratic(cov, extra, cap)
        for _ in range(50):  # the best ratio is where the trade-off equals the portfolio's own return over variance
            back = extra @ w
            if back <= 0:
                break
            new = quadratic(cov * (back / (w @ cov @ w)), extra, cap, w)
            if np.abs(new - w).max() < 1e-9:
                return new
            w = new
        if extra @ w > 0:
            return w
    return quadratic(cov + 0.0, np.zeros(n), cap)


def tidy(w: np.ndarray, cap: float) -> np.ndarray:
    """Small weights dropped, the rest within the cap and summing to one again."""
    w = np.where(w < CUTOFF, 0.0, np.clip(w, 0, cap))
    return w / w.sum() if w.sum() > 0 else w


def optimized_weights(windows: DataFrame, objective: str = "max_sharpe", by: str = "date", name: str = "sid", time: str = "day", ret: str = "ret", expected: str | None = None, rf: float = 0.0, cap: float = CAP, periods: int = 252) -> DataFrame:
    """(by, name, weight): windows has the returns of a date's candidates, (by, name, time, ret[, expected]). Names that miss a
    day are left out; without two names there are no weights. A group is one date's pool, some hundred names of a year."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index=time, columns=name, values=ret).dropna(axis=1)
        if m.shape[1] < 2 or m.shape[0] < 3:
            return pd.DataFrame({by: [], name: [], "weight": []})
        cov = shrunk_covariance(m.to_numpy(), periods)
        mu = m.mean().to_numpy() * periods if expected is None else pdf.groupby(name)[expected].first().reindex(m.columns).to_numpy(float)
        w = tidy(solve(mu, cov, objective, rf, cap), max(cap, 1 / m.shape[1]))
        return pd.DataFrame({by: pdf[by].iloc[0], name: m.columns, "weight": w})[w > 0]

    kinds = f"{by} {windows.schema[by].dataType.simpleString()}, {name} {windows.schema[name].dataType.simpleString()}, weight double"
    return by_key(windows, by).groupBy(by).applyInPandas(run, kinds)


def mean_variance(market: DataFrame, decide, top: int = 100, lookback: int = 252, coverage: float = 0.95, objective: str = "max_sharpe", cap: float = CAP, rf: float = 0.0, among: DataFrame | None = None, expected: DataFrame | None = None) -> DataFrame:
    """(date, sid, weight) on all decision dates: the most liquid names (of ``among``: date, sid, if given), those with enough returns in
    the window, missing ones as nought, weighted by the objective. expected: (date, sid, expected) instead of the window's mean."""
    from pyspark.sql import functions as F

    from tidewater.operators.signals import top_liquid

    pool = market.filter(decide)
    if among is not None:
        pool = pool.join(among.select("date", "sid"), ["date", "sid"], "left_semi")
    picks = top_liquid(pool, top).select("date", "sid", F.col("idx").alias("_at"))
    if expected is not None:
        picks = picks.join(expected.select("date", "sid", "expected"), ["date", "sid"])
    days = market.select(F.col("idx").alias("day")).distinct()
    grid = picks.join(F.broadcast(days), (F.col("day") > F.col("_at") - lookback) & (F.col("day") <= F.col("_at")))  # a row a session
    rets = market.select(F.col("sid").alias("_s"), F.col("idx").alias("_d"), "ret_cc")
    full = grid.join(rets, (F.col("sid") == F.col("_s")) & (F.col("day") == F.col("_d")), "left")
    from pyspark.sql import Window

    share = F.count("ret_cc").over(Window.partitionBy("date", "sid")) / float(lookback)
    rows = full.withColumn("_c", share).filter(F.col("_c") >= coverage).withColumn("ret", F.coalesce("ret_cc", F.lit(0.0)))
    columns = ["date", "sid", "day", "ret", *(["expected"] if expected is not None else [])]
    return optimized_weights(rows.select(*columns), objective, expected="expected" if expected is not None else None, rf=rf, cap=cap)


def blend(risky: DataFrame, safe: DataFrame, tilts: DataFrame) -> DataFrame:
    """(date, sid, weight): the safe weights' share rises with the date's ``tilt`` (0 to 1; a date without one has none)."""
    from pyspark.sql import functions as F

    both = risky.select("date", "sid", F.col("weight").alias("_r")).join(safe.select("date", "sid", F.col("weight").alias("_s")), ["date", "sid"], "full").join(F.broadcast(tilts.select("date", "tilt")), "date", "left")
    a = F.coalesce("tilt", F.lit(0.0))
    return both.select("date", "sid", ((1 - a) * F.coalesce("_r", F.lit(0.0)) + a * F.coalesce("_s", F.lit(0.0))).alias("weight")).filter("weight > 0")
