"""Window expressions: ranks with average ties, rolling statistics with a least count, growth, drawdown, percentiles.

Every order is made total by the caller. Ranks leave nulls unranked. Rolling results are null until the frame holds the
least number of non-null values.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewater.functions.spread import by_key


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def avg_rank(value, by: list) -> Column:
    """Rank from 1, ties at their mean rank, nulls null."""
    v = col(value)
    keys = [*map(col, by), v.isNull()]
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(v))
    ties = F.count("*").over(Window.partitionBy(*keys, v))
    return F.when(v.isNotNull(), rank + (ties - 1) / 2.0)


def known(value, by: list) -> Column:
    return F.count(col(value)).over(Window.partitionBy(*map(col, by)))


def pct_rank_mid(value, by: list) -> Column:
    """(average rank - 0.5) / known values."""
    return (avg_rank(value, by) - 0.5) / known(value, by)


def pct_rank(value, by: list, least: int = 1) -> Column:
    """Average rank / known values, null in groups of fewer than ``least`` rows."""
    size = F.count("*").over(Window.partitionBy(*map(col, by)))
    return F.when(size >= least, avg_rank(value, by) / known(value, by))


def rows(key, order, first: int, last: int):
    keys = [*map(col, key)] if isinstance(key, list) else [col(key)]
    return Window.partitionBy(*keys).orderBy(col(order)).rowsBetween(first, last)


def rolling(agg, value, key, order, n: int, least: int | None = None) -> Column:
    """``agg`` over the last ``n`` rows, null while they hold fewer than ``least`` (default all) known values."""
    frame = rows(key, order, -(n - 1), 0)
    return F.when(F.count(col(value)).over(frame) >= (least or n), agg(col(value)).over(frame))


def rolling_median(value, key, order, n: int, least: int) -> Column:
    return rolling(lambda x: F.percentile(x, F.lit(0.5)), value, key, order, n, least)


def growth(ret, key, order) -> Column:
    """Compounded growth of one unit; a missing return counts as nought."""
    return F.exp(F.sum(F.log1p(F.coalesce(col(ret), F.lit(0.0)))).over(rows(key, order, Window.unboundedPreceding, 0)))


def drawdown(nav, key, order, start: float | None = None) -> Column:
    """nav against its highest value so far, which ``start`` is one of if given."""
    top = F.max(col(nav)).over(rows(key, order, Window.unboundedPreceding, 0))
    return col(nav) / (top if start is None else F.greatest(top, F.lit(start))) - 1


def islands(df: DataFrame, key: list[str], order: str, flag: Column) -> DataFrame:
    """Adds ``island``: a number for each unbroken run of rows with the same flag."""
    w = Window.partitionBy(*key).orderBy(order)
    change = F.when(flag.eqNullSafe(F.lag(flag).over(w)), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn("island", F.sum("_change").over(w)).drop("_change")


def expanding_percentile(df: DataFrame, key: list[str], order: str, value: str, least: int, inclusive: bool = False, out: str = "pct") -> DataFrame:
    """Share of the key's known values so far that lie below (``inclusive``: not above) the row's, null before ``least`` values.

    One pass over sorted partitions; held are only the current key's values so far, sorted, at eight bytes each. NaN counts as infinity."""
    df = df.drop(out).withColumn("_value", F.col(value).cast("double"))
    place = bisect_right if inclusive else bisect_left

    def fold(batches):
        now, past = None, array("d")
        for batch in batches:
            keys, shares = zip(*[batch.column(k).to_pylist() for k in key]), []
            for k, v in zip(keys, batch.column(batch.schema.get_field_index("_value")).to_pylist()):
                if k != now:
                    now, past = k, array("d")
                if v is None:
                    shares.append(None)
                    continue
                v = math.inf if math.isnan(v) else v
                past.insert(bisect_right(past, v), v)
                shares.append(place(past, v) / len(past) if len(past) >= least else None)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns - 1)], pa.array(shares, pa.float64())], names=[*batch.schema.names[:-1], out])

    kept = StructType([*[f for f in df.schema.fields if f.name != "_value"], StructField(out, DoubleType())])
    return by_key(df, *key).sortWithinPartitions(*key, order).mapInArrow(fold, kept)
