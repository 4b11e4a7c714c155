"""Macro context: series known at a date, environment, factor sensitivities, regimes, stress, conditions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.lineage import cut
from tidewater.functions.spread import by_key
from tidewater.functions.windows import expanding_percentile
from tidewater.operators.asof import asof_backward

# Days of the short and the long change, least values of a percentile.
CHANGE_DAYS, YEAR_DAYS, PERCENTILE_LEAST = 91, 365, 20
#: Names that one task standardises at once for the absorption ratio, about.
NAMES = 4096


def yearly_change(series: DataFrame, periods: int = 12) -> DataFrame:
    """Monthly series as growth over ``periods`` rows before."""
    before = F.lag("value", periods).over(Window.partitionBy("series").orderBy("date"))
    return series.withColumn("value", F.try_divide(F.col("value"), before) - 1).filter("value is not null")


def known_at(dates: DataFrame, series: DataFrame, out: str = "value", shift_days: int = 0, date: str = "date") -> DataFrame:
    """(date, series, out): each series' newest value available at the date less ``shift_days``, all series in one pass."""
    names = series.select("series").distinct()
    grid = dates.select(F.col(date).alias("date")).distinct().crossJoin(F.broadcast(names))  # a handful of series
    grid = grid.withColumn("_at", F.date_sub("date", shift_days))
    found = asof_backward(grid, series.select("series", "available", F.col("date").alias("_d"), F.col("value").alias(out)), ["series"], "_at", "available", [out], tiebreak=["_d"])
    return found.select("date", "series", out)


def environment(dates: DataFrame, series: DataFrame, kinds: dict[str, str] | None = None, short: int = CHANGE_DAYS, long: int = YEAR_DAYS, least: int = PERCENTILE_LEAST) -> DataFrame:
    """(date, series, level, chg_short, chg_long, pct): changes in logs for series of kind "log", else differences; the percentile is
    the newest known value's among all values of the series known by then."""
    now = known_at(dates, series, "level")
    ranked = expanding_percentile(series.withColumn("_order", F.struct("available", "date")), ["series"], "_order", "value", least)
    pct = known_at(dates, ranked.select("series", "date", "available", F.struct(F.col("pct").alias("p")).alias("value")), "_pct").select("date", "series", F.col("_pct.p").alias("pct"))
    a, b = known_at(dates, series, "_a", short), known_at(dates, series, "_b", long)
    all_ = now.join(a, ["date", "series"]).join(b, ["date", "series"]).join(pct, ["date", "series"])
    logs = [k for k, v in (kinds or {}).items() if v == "log"]
    is_log = F.col("series").isin(logs) if logs else F.lit(False)
    change = lambda c: F.when(is_log, F.when((F.col("level") > 0) & (F.col(c) > 0), F.ln(F.col("level") / F.col(c)))).otherwise(F.col("level") - F.col(c))
    return all_.select("date", "series", "level", change("_a").alias("chg_short"), change("_b").alias("chg_long"), "pct")


def spread(env: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Level and changes of one series less another's (a curve's slope), as a series of its own without percentile."""
    x = env.filter(F.col("series") == a).select("date", *[F.col(c).alias(f"_{c}") for c in ("level", "chg_short", "chg_long")])
    y = env.filter(F.col("series") == b)
    gaps = [(F.col(f"_{c}") - F.col(c)).alias(c) for c in ("level", "chg_short", "chg_long")]
    return x.join(y, "date").select("date", F.lit(name).alias("series"), *gaps, F.lit(None).cast("double").alias("pct"))


def wide(env: DataFrame, names: list[str], columns: list[str] = ["level", "chg_short", "chg_long", "pct"]) -> DataFrame:
    """One row a date, a column for each of the named series and columns; the names are given, so no pass finds them."""
    return env.groupBy("date").pivot("series", names).agg(*[F.first(c).alias(c) for c in columns])


def market_valuation(rows: DataFrame, by: list[str], weight: str, ratios: list[str]) -> DataFrame:
    """Weighted means of per-name ratios, names without the ratio left out of its weight: a ratio of sums."""
    ok = lambda r: F.col(r).isNotNull() & F.col(weight).isNotNull()
    return rows.groupBy(*by).agg(*[F.try_divide(F.sum(F.when(ok(r), F.col(r) * F.col(weight))), F.sum(F.when(ok(r), F.col(weight)))).alias(r) for r in ratios])


def factor_betas(returns: DataFrame, factors: list[str], by: list[str], coverage: float = 0.8, periods: int | None = None) -> DataFrame:
    """(by, factor, beta): multiple regression with intercept of ``ret`` on the factor columns, one small solve a group.
    Groups hold one name's window, at most ``periods`` rows."""
    need = coverage * periods if periods else len(factors) + 2

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ok = pdf[["ret", *factors]].dropna()
        beta = np.full(len(factors), np.nan)
        if len(ok) >= max(need, len(factors) + 2):
            x = np.column_stack([np.ones(len(ok)), ok[factors].to_numpy(float)])
            beta = np.linalg.lstsq(x, ok["ret"].to_numpy(float), rcond=None)[0][1:]
        out = pd.DataFrame({"factor": factors, "beta": [None if np.isnan(b) else float(b) for b in beta]})
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out[[*by, "factor", "beta"]]

    kinds = ", ".join(f"{c} {returns.schema[c].dataType.simpleString()}" for c in by)
    return by_key(returns.select(*by, "ret", *factors), *by).groupBy(*by).applyInPandas(solve, f"{kinds}, factor string, beta double")


def simple_beta(returns: DataFrame, by: list[str], y: str = "ret", x: str = "market") -> DataFrame:
    """One-factor slope as an aggregate."""
    return returns.groupBy(*by).agg(F.regr_slope(y, x).alias("beta"), F.regr_count(y, x).alias("n"))


def tailwinds(betas: DataFrame, env: DataFrame) -> DataFrame:
    """(date, sid, factor, tailwind, total): beta times the factor's short change; the total counts unknown as nought."""
    e = env.select("date", F.col("series").alias("factor"), "chg_short")
    out = betas.join(F.broadcast(e), ["date", "factor"], "left").withColumn("tailwind", F.col("beta") * F.col("chg_short"))
    return out.select("date", "sid", "factor", "tailwind", F.sum(F.coalesce("tailwind", F.lit(0.0))).over(Window.partitionBy("date", "sid")).alias("total"))


def absorption(returns: DataFrame, by: list[str], name: str = "sid", time: str = "date", ret: str = "ret", coverage: float = 0.9, least: int = 10) -> DataFrame:
    """(by, absorption): share of the correlation matrix's variance in its largest fifth of eigenvalues. Names with enough of the
    group's days take part, missing ones count as nought; null under ``least`` moving names. A group is one window of a pool.

    The names' standardised returns Z (days by names) give the correlations as Z'Z, whose eigenvalues other than nought are those of
    ZZ', days by days: a sum over the names, which tasks take by chunks of about NAMES. No matrix has more rows than days or chunk names."""
    value = F.when(F.col(name).isNotNull() & F.col(time).isNotNull() & ~F.isnan(ret), F.col(ret))
    rows = cut(returns.withColumn("_ret", value).groupBy(*by, F.col(name).alias("_name"), F.col(time).alias("_time")).agg(F.avg("_ret").alias("_ret")))
    groups, rows = rows.select(*by).distinct(), rows.filter("_ret is not null")

    def meet(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
        b = b.withColumnsRenamed({c: f"_at_{c}" for c in keys})
        return a.join(b, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in keys], how).drop(*[f"_at_{c}" for c in keys])

    days = rows.select(*by, "_time").distinct()
    days = days.withColumn("_day", F.row_number().over(Window.partitionBy(*by).orderBy("_time")) - 1).withColumn("_days", F.count("*").over(Window.partitionBy(*by)))
    sizes = rows.groupBy(*by).agg(F.ceil(F.approx_count_distinct("_name") / NAMES).cast("long").alias("_parts"))
    dealt = meet(rows, meet(days, sizes, by), [*by, "_time"]).withColumn("_part", F.pmod(F.xxhash64("_name"), "_parts")).drop("_time")

    def gram(part: pa.Table) -> pa.Table:
        column = lambda c: part.column(c).to_numpy()
        t, day, value = part.column("_days")[0].as_py(), column("_day"), column("_ret")
        kinds = part.column("_name").combine_chunks().dictionary_encode()
        at = kinds.indices.to_numpy()
        enough = np.bincount(at, minlength=len(kinds.dictionary)) >= int(coverage * t)
        x = np.zeros((len(enough), t))
        x[at, day] = value
        with np.errstate(invalid="ignore", over="ignore"):
            z = x[enough & np.isfinite(x).all(axis=1) & (x.max(axis=1) > x.min(axis=1))]
            z = z - z.mean(axis=1, keepdims=True)
            z /= np.sqrt((z * z).sum(axis=1, keepdims=True))
        z = z[np.isfinite(z).all(axis=1)]
        whole = part.column("_parts")[0].as_py() == 1 and len(z) < t  # fewer names than days, and no other chunk to add
        m = z @ z.T if whole else z.T @ z
        return part.slice(0, 1).select(by).append_column("_n", pa.array([len(z)], pa.int64())).append_column("_m", pa.array([m.ravel()], pa.list_(pa.float64())))

    def share(parts: pa.Table) -> pa.Table:
        n, value = sum(parts.column("_n").to_pylist()), None
        if n >= least:
            m = sum(x.values.to_numpy() for x in parts.column("_m"))
            e = np.sort(np.linalg.eigvalsh(m.reshape(math.isqrt(len(m)), -1)))[::-1]
            value = float(e[: max(1, n // 5)].sum() / e.sum())
        return parts.slice(0, 1).select(by).append_column("absorption", pa.array([value], pa.float64()))

    kinds = ", ".join(f"{c} {returns.schema[c].dataType.simpleString()}" for c in by)
    grams = by_key(dealt, *by, "_part").groupBy(*by, "_part").applyInArrow(gram, f"{kinds}, _n long, _m array<double>")
    shares = by_key(grams, *by).groupBy(*by).applyInArrow(share, f"{kinds}, absorption double")
    return meet(groups, shares, by, "left")


def market_state(index: DataFrame, fear: DataFrame | None = None, average: int = 200, step: int = 21, bear: float = 0.15, rebound: float = 0.20, high: int = 504, easing: float = 0.20, history: int = 294) -> DataFrame:
    """(date, state): bear where the index is below its long average now and at the two month steps before and down ``bear`` from
    its two-year high; rebound, which comes first, where it is down ``rebound`` and the newest month's fear is ``easing`` below the
    top of the last three; else, and before ``history`` days, normal. index: (date, idx, nav); fear: (date, fear) at month ends."""
    w = Window.orderBy("idx")  # one series
    avg = F.avg("nav").over(w.rowsBetween(-(average - 1), 0))
    full = F.count("nav").over(w.rowsBetween(-(average - 1), 0)) == average
    d = index.withColumn("_below", F.when(full, F.col("nav") < avg)).withColumn("_down", 1 - F.col("nav") / F.max("nav").over(w.rowsBetween(-(high - 1), 0)))
    three = F.col("_below") & F.lag("_below", step).over(w) & F.lag("_below", 2 * step).over(w)
    known = F.row_number().over(w) >= history
    d = d.withColumn("_bear", F.coalesce(known & three & (F.col("_down") >= bear), F.lit(False))).withColumn("_known", known)
    if fear is None:
        return d.select("date", F.when(F.col("_bear"), "bear").otherwise("normal").alias("state"))
    m = Window.orderBy("date").rowsBetween(-2, 0)
    f = fear.select("date", F.when(F.count("fear").over(m) == 3, F.col("fear") <= (1 - easing) * F.max("fear").over(m)).alias("_eased"))
    d = d.join(f, "date", "left").withColumn("_eased", F.last("_eased", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    back = F.coalesce(F.col("_known") & F.col("_eased") & (F.col("_down") >= rebound), F.lit(False))
    return d.select("date", F.when(back, "rebound").when(F.col("_bear"), "bear").otherwise("normal").alias("state"))


def month_end_state(index: DataFrame, market: DataFrame, month_ends: DataFrame, year: int = 252, average: int = 200) -> DataFrame:
    """(date, drawdown, below_ma200, vol3m, breadth, fwd_1m, fwd_3m, fwd_6m) at month ends: of the index (date, idx, nav, ret), and the
    share of names (sid, date, idx, growth, eligible) above their own long average."""
    w = Window.orderBy("idx")  # one series
    i = index.withColumns({
        "drawdown": 1 - F.col("nav") / F.max("nav").over(w.rowsBetween(-2 * year, 0)),
        "below_ma200": F.col("nav") < F.avg("nav").over(w.rowsBetween(-(average - 1), 0)),
        "vol3m": F.stddev_pop("ret").over(w.rowsBetween(-62, 0)) * F.sqrt(F.lit(float(year))),
        **{f"fwd_{n}m": F.lead("nav", n * 21).over(w) / F.col("nav") - 1 for n in (1, 3, 6)},
    })
    own = F.avg("growth").over(Window.partitionBy("sid").orderBy("idx").rangeBetween(-(average - 1), 0))
    above = market.withColumn("_above", (F.col("growth") > own).cast("double")).filter("eligible").groupBy("date").agg(F.avg("_above").alias("breadth"))
    names = ["date", "drawdown", "below_ma200", "vol3m", "breadth", "fwd_1m", "fwd_3m", "fwd_6m"]
    return i.filter(F.col("idx") >= year).join(month_ends.select("date"), "date", "left_semi").join(above, "date", "left").select(*names)


def regime_signals(months: DataFrame) -> DataFrame:
    """Flags of month-end rows (date, drawdown, below_ma200, vol3m, breadth, absorption, vix, baa_spread, curve): absorption rising over a
    standard deviation above its past year, divergences near a high, an inverted curve, calm, bear and rebound."""
    w = Window.orderBy("date")  # one row a month
    c = F.col
    near = c("drawdown") <= 0.05
    past = F.lag("absorption").over(w)
    d = expanding_percentile(months.withColumn("_one", F.lit(1)), ["_one"], "date", "vol3m", 1, inclusive=True, out="vol_pct").withColumn("_past", past)
    year = w.rowsBetween(-11, 0)
    rising = F.when(F.count("_past").over(year) == 12, F.try_divide(c("absorption") - F.avg("_past").over(year), F.stddev_samp("_past").over(year)) > 1)
    three = w.rowsBetween(-2, 0)
    return d.withColumns({
        "absorption_rising": rising,
        "credit_divergence": near & (c("baa_spread") - F.lag("baa_spread", 3).over(w) > 0.25),
        "breadth_divergence": near & (c("breadth") - F.lag("breadth", 3).over(w) < -0.10),
        "curve_inverted": c("curve") < 0,
        "complacent": c("vol_pct") <= 0.2,
        "bear": (F.sum(c("below_ma200").cast("int")).over(three) == 3) & (F.count("below_ma200").over(three) == 3) & (c("drawdown") >= 0.15),
        "rebound": (c("drawdown") >= 0.20) & F.when(F.count("vix").over(three) == 3, c("vix") <= 0.8 * F.max("vix").over(three)),
    }).drop("_one", "_past")


def panic(index: DataFrame, year: int = 252) -> DataFrame:
    """(date, panic): fall from the two-year high times half a year's annualised volatility, both positive; null in the first year."""
    w = Window.orderBy("idx")  # one series
    down = 1 - F.col("nav") / F.max("nav").over(w.rowsBetween(-(2 * year - 1), 0))
    vol = F.stddev_samp("ret").over(w.rowsBetween(-(year // 2 - 1), 0)) * F.sqrt(F.lit(float(year)))
    return index.select("date", F.when(F.row_number().over(w) >= year, down * vol).alias("panic"))


def stress_gauge(inputs: DataFrame, names: list[str], least: int = 24, neutral: float = 0.5) -> DataFrame:
    """(date, gauge): mean of the inputs' expanding percentiles (not above) from ``least`` values on, then that mean's own expanding
    percentile from ``least`` means on; ``neutral`` before. inputs: one row a date."""
    long = inputs.select("date", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])))
    pct = expanding_percentile(long.filter("value is not null"), ["name"], "date", "value", least, inclusive=True)
    mean = pct.groupBy("date").agg(F.avg("pct").alias("_mean")).filter("_mean is not null").withColumn("_one", F.lit(1))
    out = expanding_percentile(mean, ["_one"], "date", "_mean", least, inclusive=True, out="_g")
    return inputs.select("date").join(out.select("date", "_g"), "date", "left").select("date", F.coalesce("_g", F.lit(neutral)).alias("gauge"))


def tilt(gauge: Column, low: float, high: float) -> Column:
    """0 up to ``low``, 1 from ``high``, a line between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (gauge - low) / (high - low)))


def downside_vol(ret: str, key, order, n: int) -> Column:
    """Root mean square of the negative returns in the last ``n`` rows."""
    keys = key if isinstance(key, list) else [key]
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    return F.sqrt(F.avg(F.least(F.col(ret), F.lit(0.0)) * F.least(F.col(ret), F.lit(0.0))).over(w))


def forward_stats(series: DataFrame, ahead: int, key: str = "key") -> DataFrame:
    """(key, date, fwd_ret, fwd_vol, fwd_dd) over the next ``ahead`` rows, null where fewer remain. The window's rows are folded in order."""
    w = Window.partitionBy(key).orderBy("date").rowsBetween(1, ahead)
    r = F.collect_list("ret").over(w)
    zero = F.struct(F.lit(1.0).alias("g"), F.lit(1.0).alias("top"), F.lit(0.0).alias("dd"))

    def step(acc, x):
        g = acc["g"] * (1 + x)
        top = F.greatest(acc["top"], g)
        return F.struct(g.alias("g"), top.alias("top"), F.least(acc["dd"], g / top - 1).alias("dd"))

    full = F.count("ret").over(w) == ahead
    d = series.withColumn("_r", r).withColumn("_full", full).withColumn("fwd_vol", F.when(full, F.stddev_pop("ret").over(w)))
    d = d.withColumn("_f", F.when(F.col("_full"), F.aggregate("_r", zero, step)))
    return d.select(key, "date", (F.col("_f.g") - 1).alias("fwd_ret"), "fwd_vol", F.col("_f.dd").alias("fwd_dd"))
