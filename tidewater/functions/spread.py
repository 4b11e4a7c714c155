"""Placement of rows for grouped Python work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows by key into the session's number of shuffle partitions. Adaptive execution would join small shuffles into few
    tasks by their bytes, but a grouped fold is heavy per row; the grouping that follows uses this exchange as its own."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
