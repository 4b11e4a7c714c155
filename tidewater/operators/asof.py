"""As-of joins without look-ahead: one shuffle on the keys, one ordered window, no row explosion."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], strict: bool = False, tiebreak: list[str] | None = None, max_age_days: int | None = None, suffix: str = "") -> DataFrame:
    """``left`` with the ``values`` of the newest right row at or before its time (``strict``: before), per keys.

    Of right rows at one time the last by ``tiebreak`` counts. Values older than ``max_age_days`` become null."""
    tiebreak = tiebreak or []
    names = [v + suffix for v in values]
    packed = F.struct(F.col(right_time).alias("_seen"), *[F.col(v).alias(n) for v, n in zip(values, names)])
    ties = [F.col(t).alias(f"_t{i}") for i, t in enumerate(tiebreak)]
    r = right.select(*keys, F.col(right_time).alias("_at"), F.lit(0 if not strict else 1).alias("_tag"), *ties, packed.alias("_right"), F.lit(None).cast(left.schema).alias("_left"))
    blank = [F.lit(None).cast(right.schema[t].dataType).alias(f"_t{i}") for i, t in enumerate(tiebreak)]
    row = F.struct(*[F.col(c) for c in left.columns])
    n = left.select(*keys, F.col(left_time).alias("_at"), F.lit(1 if not strict else 0).alias("_tag"), *blank, F.lit(None).cast(r.schema["_right"].dataType).alias("_right"), row.alias("_left"))
    order = [F.col("_at"), F.col("_tag"), *[F.col(f"_t{i}").asc_nulls_first() for i in range(len(tiebreak))]]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(n).withColumn("_hit", F.last("_right", ignorenulls=True).over(w)).filter("_left is not null")
    hit = F.col("_hit")
    if max_age_days is not None:
        hit = F.when(F.datediff(F.col("_at"), F.col("_hit._seen")) <= max_age_days, hit)
        both = both.withColumn("_hit", hit)
    return both.select("_left.*", *[F.col(f"_hit.{n}").alias(n) for n in names])


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], left_date: str, right_date: str, values: list[str], tolerance_days: int, tiebreak: list[str] | None = None, row_key: list[str] | None = None, suffix: str = "") -> DataFrame:
    """``left`` with the right row nearest in days within the tolerance; of equally near ones the later date, then ``tiebreak`` (descending).

    ``row_key`` identifies a left row (default all of its columns). Days are cut into blocks of the tolerance plus one; a left row
    probes its own block and both neighbours, so it meets only right rows at most two blocks away, however many its key has. Only
    probes (``row_key``, keys, date) and their best match shuffle; left rows join the match at the end."""
    row_key = row_key or left.columns
    block = tolerance_days + 1
    of_day = lambda c: F.floor(F.unix_date(F.col(c)) / block)
    found = [F.col(right_date).alias("_rd"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(tiebreak or [])], *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)]]
    r = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], of_day(right_date).alias("_rb"), F.struct(*found).alias("_r"))
    probes = left.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(row_key)], *[F.col(k).alias(f"_lk{i}") for i, k in enumerate(keys)], F.col(left_date).alias("_ld")).distinct()
    near = probes.withColumn("_lb", F.explode(F.sequence(of_day("_ld") - 1, of_day("_ld") + 1)))
    same = reduce(and_, [F.col(f"_lk{i}") == F.col(f"_k{i}") for i in range(len(keys))], F.col("_lb") == F.col("_rb"))
    gap = F.abs(F.datediff("_ld", "_r._rd"))
    # The largest of these structs is the nearest, then the latest, then the last by tiebreak.
    best = near.join(r, same & (gap <= tolerance_days)).groupBy(*[f"_p{i}" for i in range(len(row_key))]).agg(F.max(F.struct((-gap).alias("_near"), "_r")).alias("_best"))
    on = reduce(and_, [left[c].eqNullSafe(best[f"_p{i}"]) for i, c in enumerate(row_key)])
    return left.join(best, on, "left").select(*[left[c] for c in left.columns], *[F.col(f"_best._r._v{i}").alias(v + suffix) for i, v in enumerate(values)])
