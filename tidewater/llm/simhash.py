"""SimHash near-duplicates by pivot distance tables.

A fingerprint has a bit set where over half of a text's shingle hashes have it. For linking, a table holds each distinct
fingerprint's Hamming distances to PIVOTS reference fingerprints, computed once. Two fingerprints that differ in at most
DISTANCE bits have distances that differ by at most DISTANCE at every pivot (triangle inequality), so pairs with a larger
difference at any pivot are discarded, and only survivors are verified bit by bit.

So that not all pairs are looked at, rows meet only where two of six bit ranges are equal: four differing bits touch four
of the six ranges at most, so every link is met in some table (exact). From WIDE distinct fingerprints on there are seven
ranges of which three are equal, which is exact too and keeps buckets small. Within a bucket rows stand in the order of their
distances, and a row meets only those whose distance to the first pivot is at most DISTANCE more. A bucket of over CHUNK rows
is dealt out as pairs of chunks, so no task holds more than two chunks of one bucket at once. Tasks give only the links that
join what they had not joined yet, a forest, never all pairs, and forget what they joined after FOREST fingerprints, which
gives some links twice; components follow in distributed rounds.

Defined cases: a null text counts as empty and has fingerprint zero, linked like any other; a null id takes part, is never
the smallest unless all ids of its component are null; rows of equal id are rows of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import ROW, broadcast_if_small, numbered, own, slices, staged, table, without
from tidewater.llm.components import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
PIVOTS = 16
CHUNK, WIDE = 512, 50_000_000
#: Rows from which a fingerprint's copies count as hot, and the most such fingerprints that are broadcast.
HOT, MAX_HOT = 200, 1_000_000
#: Fingerprints whose joins a task remembers.
FOREST = 500_000


def fingerprint(text: str | None, shingle: int = SHINGLE, hash64=None) -> int:
    """The fingerprint of one text: words split at ASCII white space, A-Z lower-cased."""
    if hash64 is None:
        from xxhash import xxh64_intdigest as hash64
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = [hash64(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1]
        hashes = [hash64(joined[a:b], SEED) for a, b in zip(starts[: len(starts) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    count, n = np.zeros(64, np.int64), len(hashes)
    for k in range(0, n, 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, row_col: str | None = None) -> DataFrame:
    """(id, row, fp): the number in row_col, 0 without it; fp is the fingerprint's 64 bits as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own("simhash")
        from xxhash import xxh64_intdigest

        for part in slices(batches):
            out = np.array([fingerprint(t, shingle, xxh64_intdigest) for t in part.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out.view(np.int64))], names=["id", "row", "fp"])

    row = F.col(row_col) if row_col else F.lit(0).cast("long")
    return docs.select(docs[id_col].alias("id"), row.alias("row"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, row long, fp long")


@lru_cache(maxsize=1)
def pivots() -> np.ndarray:
    """The reference fingerprints, fixed by a seed."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)


def distance_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances to each pivot, one row a fingerprint."""
    return np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)


def masks(ranges: int, equal: int) -> list[int]:
    """Bit masks of the ranges that must be equal; signed, as Spark's longs are."""
    edges = [round(64 * k / ranges) for k in range(ranges + 1)]
    bits = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(bits, equal))]


def with_distances(fps: DataFrame) -> DataFrame:
    """(fp, near): distinct fingerprints with their distances to the pivots, a byte each."""

    def run(batches):
        for batch in batches:
            near = distance_table(batch.column(0).to_numpy().view(np.uint64)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in near], pa.binary())], names=["fp", "near"])

    return fps.select("fp").mapInArrow(run, "fp long, near binary")


def _links(distance: int):
    """Rows (t, bucket, pair, fp, near) sorted by bucket and distances; gives a forest of the links met in the task."""

    def run(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = parent[x]
            return x

        rest, far = None, None
        for batch in _and_end(batches):
            if batch is not None:
                now = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)])
                held = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, PIVOTS).astype(np.int8)
                rest, far = (now, held) if rest is None else (np.concatenate([rest, now], axis=1), np.concatenate([far, held]))
                if not rest.shape[1]:
                    continue
                same = (rest[:3] == rest[:3, -1:]).all(axis=0)
                cut = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0
            elif rest is None:
                return
            else:
                cut = rest.shape[1]
            if not cut:
                continue
            part, near, rest, far = rest[:, :cut], far[:cut], rest[:, cut:], far[cut:]
            key, fps = part[:3], part[3].view(np.uint64)
            new = np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]
            group = np.cumsum(new) - 1
            size = np.bincount(group)
            many = size[group] > 1
            fps, group, near = fps[many], group[many], near[many]
            if not len(fps):
                continue
            out_a, out_b = [], []
            live, step = np.arange(len(fps)), 1
            while len(live):
                live = live[live + step < len(fps)]
                live = live[(group[live] == group[live + step]) & (near[live + step, 0] - near[live, 0] <= distance)]
                for k in range(0, len(live), 1 << 18):
                    i = live[k : k + (1 << 18)]
                    i = i[(np.abs(near[i] - near[i + step]) <= distance).all(axis=1)]
                    i = i[np.bitwise_count(fps[i] ^ fps[i + step]) <= distance]
                    for a, b in zip(fps[i].view(np.int64).tolist(), fps[i + step].view(np.int64).tolist()):
                        x, y = root(a), root(b)
                        if x != y:
                            parent[max(x, y)] = min(x, y)
                            out_a.append(a)
                            out_b.append(b)
                step += 1
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
            if len(parent) > FOREST:
                parent.clear()

    return run


def _and_end(batches):
    yield from batches
    yield None


def near_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): a forest of the links between distinct fingerprints ``fp`` at ``distance`` or fewer differing bits."""
    wide = fps.count() >= WIDE
    cuts = masks(distance + 3, 3) if wide else masks(distance + 2, 2)
    near = staged(with_distances(fps), "distances")
    rows = near.select("fp", "near", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in cuts])).alias("t", "bucket"))
    large = staged(rows.groupBy("t", "bucket").agg(F.count("*").alias("n")).filter(F.col("n") > CHUNK), "buckets")
    large = large.select(F.col("t").alias("lt"), F.col("bucket").alias("lb"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    at = (F.col("t") == F.col("lt")) & (F.col("bucket") == F.col("lb"))
    large = broadcast_if_small(large, MAX_HOT)
    small = rows.join(large.select("lt", "lb"), at, "left_anti").select("t", "bucket", F.lit(0).cast("long").alias("pair"), "fp", "near")
    # Chunk i of a large bucket goes to each pair (i, j) and (j, i) of chunks, so any two rows meet.
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = rows.join(large, at).withColumn("own", own).select("t", "bucket", "chunks", "own", "fp", "near", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("t", "bucket", (F.least("own", "other").cast("long") * F.col("chunks") + F.greatest("own", "other") + 1).alias("pair"), "fp", "near")
    every = small.unionByName(dealt).select(F.col("t").cast("long").alias("t"), "bucket", "pair", "fp", "near")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return every.repartition(n, "t", "bucket", "pair").sortWithinPartitions("t", "bucket", "pair", "near").mapInArrow(_links(distance), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, row_col: str | None = None) -> DataFrame:
    """(id, fingerprint, component_id): one row for each row of ``docs``; component_id is the smallest id reachable by links.
    With row_col, a column of numbers, also ``row`` and ``kept``: true for one row a component, the first of the smallest id."""
    rows = staged(fingerprints(docs, id_col, text_col, shingle, row_col), "fingerprints")
    order = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("row").alias("row"))
    distinct = staged(rows.groupBy("fp").agg(F.min("id").alias("low"), F.min(order).alias("first"), F.count("*").alias("n")), "distinct")
    links = staged(near_links(distinct.select("fp"), distance), "links")
    roots = components(links)
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", "first", "n", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("component_id"), F.min("first")["row"].alias("keep"))
    # Fingerprints whose component differs from their own smallest id or that have copies; others are their own component.
    linked = staged(placed.join(lowest, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id", "keep", "n"), "linked")
    hot = broadcast_if_small(linked.filter(F.col("n") >= HOT), MAX_HOT)
    out = rows.join(hot, F.col("fp") == F.col("f")).unionByName(rows.join(hot.select("f"), F.col("fp") == F.col("f"), "left_anti").join(linked.filter(F.col("n") < HOT), F.col("fp") == F.col("f")))
    extra = ["row", (F.col("row") == F.col("keep")).alias("kept")] if row_col else []
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *extra)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: the first of its smallest id (null ids last)."""
    rows = numbered(docs)
    return without(rows, simhash_groups(rows, id_col, text_col, row_col=ROW).filter("not kept").select("row"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op3_simhash": op3_simhash}
ORACLE: dict[str, str] = {}
