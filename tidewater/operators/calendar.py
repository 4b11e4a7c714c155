"""Sessions: the trading days that the data shows, with their index and the last days of weeks, months and quarters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(days: DataFrame, date: str = "date") -> DataFrame:
    """(date, idx from 0, next, prev, week_end, month_end, quarter_end). A calendar has some hundred days a year, so its
    order is taken in one partition."""
    w = Window.orderBy(date)
    d = days.select(F.col(date).alias("date")).distinct()
    out = d.select("date", (F.row_number().over(w) - 1).alias("idx"), F.lead("date").over(w).alias("next"), F.lag("date").over(w).alias("prev"))
    year_week = F.expr("extract(yearofweek from date)") * 100 + F.weekofyear("date")
    last = lambda *by: F.col("date") == F.max("date").over(Window.partitionBy(*by))
    return out.withColumns({"week_end": last(year_week), "month_end": last(F.trunc("date", "month")), "quarter_end": last(F.trunc("date", "quarter"))})


def rebalance_dates(cal: DataFrame, every: str) -> DataFrame:
    """Last session of each ISO week (W), month (M) or quarter (Q); D: every session."""
    return cal if every == "D" else cal.filter(F.col({"W": "week_end", "M": "month_end", "Q": "quarter_end"}[every]))


def weekdays(spark, start: dt.date, end: dt.date, holidays: list[dt.date] = ()) -> DataFrame:
    """A generated calendar: weekdays without the holidays given."""
    d = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date")).filter(F.dayofweek("date").between(2, 6))
    return d.filter(~F.col("date").isin(list(holidays))) if holidays else d


def last_complete_session(days: list[dt.date], now: dt.datetime, close: dt.time = dt.time(16), buffer_minutes: int = 30) -> dt.date | None:
    """The newest session that has closed ``buffer_minutes`` ago (days and now in exchange time)."""
    done = [d for d in days if now >= dt.datetime.combine(d, close) + dt.timedelta(minutes=buffer_minutes)]
    return max(done, default=None)


def freshness(days: list[dt.date], newest: dt.date | None, now: dt.datetime, grace_minutes: int = 120) -> str:
    """current, late or missing: whether the newest stored day is the last complete session, within the grace."""
    if newest is None:
        return "missing"
    want = last_complete_session(days, now)
    if want is None or newest >= want:
        return "current"
    relaxed = last_complete_session(days, now - dt.timedelta(minutes=grace_minutes))
    return "current" if relaxed is None or newest >= relaxed else "late"
