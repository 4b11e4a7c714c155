"""Structured Streaming forms: bar upserts by batch, tumbling and sliding windows with watermarks, and a stateful fold a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, time: str, keys: list[str], value: str, size: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(start, keys, n, total) by event-time windows; rows later than the watermark are dropped. Weeks start on Monday."""
    window = F.window(time, size, slide, "4 days") if size.endswith("week") and slide is None else F.window(time, size, slide)
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str = "1 day") -> DataFrame:
    """(start, end, keys, n): bursts of events that are less than ``gap`` apart."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def upsert_stream(rows: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand each micro-batch to an idempotent upsert; the checkpoint makes a restart go on where it stopped."""
    writer = rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def unique_within(rows: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """First arrival of each key within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def running_growth(rows: DataFrame, key: str, time: str, ret: str) -> DataFrame:
    """(key, n, nav, drawdown) after each micro-batch: growth of one with its running top as state."""

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, nav, top, worst = state.get if state.exists else (0, 1.0, 1.0, 0.0)
        for r in pd.concat(list(parts)).sort_values(time)[ret]:
            n, nav = n + 1, nav * (1 + r)
            top = max(top, nav)
            worst = min(worst, nav / top - 1)
        state.update((n, nav, top, worst))
        yield pd.DataFrame({key: [k[0]], "n": [n], "nav": [nav], "drawdown": [worst]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, n long, nav double, drawdown double", "n long, nav double, top double, worst double", "update", GroupStateTimeout.NoTimeout)
