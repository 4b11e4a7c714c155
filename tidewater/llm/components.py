"""Connected components of an edge table, distributed: alternating large-star and small-star rounds, each written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import staged

#: Every round at least halves the depth of the trees it works on; a run that needs more is a fault.
MAX_ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (``large``) or smaller neighbours, and for the latter itself, to the smallest node around it.

    Edges are (a, b) with a > b. The smallest neighbour is a partial aggregate, so a hub's edges never meet in one task for
    it; the join back to the edges is a plain equi-join whose hot keys adaptive execution splits."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))
        out = both.filter("v > u").join(low, F.col("u") == F.col("n")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        joined = edges.join(low, F.col("a") == F.col("n"))
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node of the component. Only nodes with an edge appear; null ends and loops are ignored."""
    now = staged(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        now = staged(_stars(staged(_stars(now, True), "large"), False), "small")
        # A star forest is a fixed point; sums of the edges' hashes tell whether a round changed the table.
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
    raise RuntimeError("components did not settle")
