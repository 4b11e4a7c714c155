"""Sharding by a permutation-filled lookup table (DataFrame operations only on the rows' path).

The driver fills a table of prime size: shards take turns, and each claims the next free slot of its own permutation of
the slots. A row's key is hashed to a slot and the broadcast table gives its shard, so placement costs one hash and one
look-up, shards differ by at most one slot, and adding or removing a shard moves few keys.

Defined cases: a null key counts as the empty text; equal keys share a shard; an empty table gives an empty result; all
columns of the input stay, and ``slot`` and ``shard`` replace columns of these names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import table

#: Shards and slots of the query: over 100 slots a shard, so that loads differ by under one in a hundred.
SHARDS, SLOTS = 32, 4093
#: The most slots a table may have: what is broadcast has this many rows at most.
MAX_SLOTS = 1 << 20


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preference(name: str, slots: int) -> tuple[int, int]:
    """(offset, step) of a shard's permutation of the slots, from the md5 of its name."""
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:15], 16) % slots, int(digest[15:30], 16) % (slots - 1) + 1


def fill(names: list[str], slots: int) -> list[int]:
    """The shard's index for each slot."""
    if not names or not _prime(slots) or not len(names) <= slots <= MAX_SLOTS:
        raise ValueError("needs one shard at least and a prime number of slots between the shards' number and MAX_SLOTS")
    at, step = map(list, zip(*(preference(x, slots) for x in names)))
    owner = [-1] * slots
    for turn in range(slots):
        k = turn % len(names)
        while owner[at[k]] >= 0:
            at[k] = (at[k] + step[k]) % slots
        owner[at[k]] = k
    return owner


def slot_of(key, slots: int):
    """A key's slot: 60 bits of the md5 of its text."""
    digest = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.conv(digest, 16, 10).cast("long") % slots


def shard(docs: DataFrame, key: str = "doc_id", names: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``slot`` and ``shard`` (index into ``names``)."""
    names = names or [f"shard-{i}" for i in range(SHARDS)]
    spark = docs.sparkSession
    kept = docs.drop("slot", "shard")
    # Spark's names don't tell upper and lower case apart.
    taken = {c.lower() for c in kept.columns}
    own = next(x for k in range(len(taken) + 1) if (x := f"slot_{k}") not in taken)
    owners = F.split(F.lit(",".join(map(str, fill(names, slots)))), ",").cast("array<int>")
    lookup = spark.range(1).select(F.posexplode(owners).alias(own, "shard"))
    out = kept.withColumn("slot", slot_of(kept[key], slots))
    return out.join(F.broadcast(lookup), F.col("slot") == F.col(own)).drop(own)


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", names: list[str] | None = None, slots: int = SLOTS, files_per_shard: int = 4) -> None:
    """Write one folder a shard; each shard's rows are dealt to ``files_per_shard`` tasks by a second part of the hash."""
    out = shard(docs, key, names, slots)
    names = names or [f"shard-{i}" for i in range(SHARDS)]
    out.repartition(len(names) * files_per_shard, "shard", F.pmod(F.xxhash64(F.col(key)), F.lit(files_per_shard))).write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", "slot", "shard")


SQL = f"""
WITH RECURSIVE pref AS (
  SELECT k, ('0x' || substr(md5('shard-' || k), 1, 15))::BIGINT % {SLOTS} AS off,
         ('0x' || substr(md5('shard-' || k), 16, 15))::BIGINT % {SLOTS - 1} + 1 AS step
  FROM range({SHARDS}) t(k)),
seq AS (SELECT k, list((off + j * step) % {SLOTS} ORDER BY j) AS perm FROM pref, range({SLOTS}) s(j) GROUP BY k),
fill(turn, taken, owner) AS (
  SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[]
  UNION ALL
  SELECT f.turn + 1,
         list_append(f.taken, list_filter(s.perm, lambda x: NOT list_contains(f.taken, x))[1]),
         list_append(f.owner, s.k)
  FROM fill f JOIN seq s ON s.k = f.turn % {SHARDS} WHERE f.turn < {SLOTS}),
lookup AS (SELECT unnest(taken) AS slot, unnest(owner) AS shard FROM fill WHERE turn = {SLOTS})
SELECT d.doc_id, l.slot, CAST(l.shard AS INTEGER) AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents) d
JOIN lookup l ON d.slot = l.slot
"""
QUERIES = {"op7_sharding": op7_sharding}
ORACLE = {"op7_sharding": SQL}
