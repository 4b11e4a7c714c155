"""Helpers of the query modules."""

from __future__ import annotations

from pyspark.sql import functions as F


def registrar():
    """(queries, sql, decorator): ``@query(sql)`` registers a function of (spark, sf_dir) by its name; sql None: rows only."""
    queries: dict = {}
    oracle: dict = {}

    def query(sql: str | None = None):
        def put(f):
            queries[f.__name__] = f
            if sql is not None:
                oracle[f.__name__] = sql
            return f

        return put

    return queries, oracle, query


def r(c, digits: int = 6):
    """A double rounded for comparison, under its own name."""
    return F.round(F.col(c), digits).alias(c)


def signed(c, digits: int = 6):
    """As ``r``, a nought with its value's sign: SQL rounds what is just below nought to -0.0, Spark to 0.0."""
    x = F.round(F.col(c), digits)
    return F.when(x == 0, F.signum(c) * 0.0).otherwise(x).alias(c)


def off(c, digits: int = 6):
    """As ``r``, moved off the halves at which sums in another order would round to another side (quotients of cents lie on them)."""
    return F.round(F.col(c) + 1e-9, digits).alias(c)
