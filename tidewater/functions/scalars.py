"""Scalar expressions shared by operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a, b) -> Column:
    """a / b where b is positive, else null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b > 0, a / b)


def ieee(a, b) -> Column:
    """a / b as SQL's doubles divide: by nought infinite, nought by nought NaN."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def sum_known(*cols) -> Column:
    """Sum of the known values; nought if none is."""
    out = F.lit(0.0)
    for c in cols:
        out = out + F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))
    return out


def mean_known(cols: list[str], least: int = 1) -> Column:
    """Mean of the known values, null if fewer than ``least`` are known."""
    n = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    return F.when(n >= least, sum_known(*cols) / n)


def bucket(value, edges: list[float], labels: list[str]) -> Column:
    """The label of the first edge above the value, the last label beyond; null stays null."""
    v = F.col(value) if isinstance(value, str) else value
    out = F.when(v.isNull(), F.lit(None))
    for edge, label in zip(edges, labels):
        out = out.when(v < edge, label)
    return out.otherwise(labels[-1])


def first_match(pairs: list[tuple[Column, str]], default: str | None = None) -> Column:
    """The value of the first condition that holds (null counts as false)."""
    out = None
    for cond, value in pairs:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default)


def guarded_corr(x: Column, y: Column) -> Column:
    """Correlation as an aggregate, null where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def conform(df, schema: dict[str, str]):
    """Exactly the schema's columns: present ones cast, missing ones null, others dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in schema.items()])
