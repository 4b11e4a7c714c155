"""Exact dedup by two-pass Bloom filtering.

Pass 1 sets bits for every text's hash in a two-level Bloom filter (seen once, seen twice). Pass 2 probes each row:
only rows whose bits were all seen twice can have a copy, and only those shuffle; the rest pass straight through.
False positives just shuffle needlessly, so the result is exact at every filter size.

The filter grows with the rows. It stands in the shared folder in slices of at most MAX_CELLS cells, a slice for each part of
the hashes, which are written by part; a probing task reads the slice of the rows that it has, one at a time, and nothing of
the filter goes through the driver.

Defined cases: a null text counts as empty; of rows that share text and id, one stays (the first in the staged table);
a null id stays only where its whole group has null ids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import ROW, broadcast_if_small, filesystem, fresh_path, numbered, staged, table, without

#: Filter cells a row, bits set a row, the most cells of a slice (2**28 cells are 32 MB in a task), cells a block.
CELLS_PER_ROW, PROBES, MAX_CELLS, BLOCK = 16, 2, 1 << 28, 1 << 14


#: Rows from which a group counts as hot, and the most hot groups that are broadcast; more of them join by shuffle.
HOT, MAX_HOT = 200, 1_000_000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """(id, row, sha): the row's number, by default in the order of reading, and sha256 of the text with each run of ASCII white space as one space."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return docs.select(F.col(id_col).alias("id"), (F.monotonically_increasing_id() if row is None else row).alias("row"), F.unhex(F.sha2(text, 256)).alias("sha"))


def slices_for(rows: int) -> tuple[int, int]:
    """(slices, cells of each) of the filter for so many rows; powers of two."""
    cells = max(BLOCK, 1 << (max(1, rows) * CELLS_PER_ROW - 1).bit_length())
    return max(1, cells // MAX_CELLS), min(cells, MAX_CELLS)


def _cells(sha: pa.Array, size: int) -> np.ndarray:
    """The cells of each digest in its slice, one column a probe; a power of two keeps them distinct by an odd step."""
    words = np.frombuffer(b"".join(sha.to_pylist()), "<u8").reshape(-1, 4)
    first, step = words[:, 0], words[:, 1] | np.uint64(1)
    return np.stack([(first + np.uint64(i) * step) % np.uint64(size) for i in range(PROBES)], axis=1).astype(np.int64)


def _mark(size: int):
    """Each task's cells, in blocks over all slices: positions seen once or more, and twice or more."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = _cells(batch.column("sha"), size) + batch.column("part").to_numpy().astype(np.int64)[:, None] * size
            cells, seen = np.unique(cells.ravel(), return_counts=True)
            block = cells // BLOCK
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            ends = np.r_[starts[1:], len(block)]
            local = (cells % BLOCK).astype("<u2")
            once = [local[a:b].tobytes() for a, b in zip(starts, ends)]
            twice = [local[a:b][seen[a:b] > 1].tobytes() for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(block[starts], pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["block", "once", "twice"])

    return run


def _merge(size: int):
    """Blocks of the whole table's filter; holds two bit arrays for each block of the partition, however many tasks wrote to it."""

    def run(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                one, two = held.setdefault(block, (np.zeros(BLOCK, bool), np.zeros(BLOCK, bool)))
                at = np.frombuffer(once, "<u2")
                two[at[one[at]]] = True
                two[np.frombuffer(twice, "<u2")] = True
                one[at] = True
        per = size // BLOCK
        out = [(b // per, b % per, np.packbits(two, bitorder="little").tobytes()) for b, (_, two) in held.items() if two.any()]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["part", "block", "bits"])

    return run


def write_filter(rows: DataFrame, slices: int, size: int) -> str:
    """The folder of the Bloom filter of digests seen twice or more, a folder a slice."""
    path = fresh_path(rows.sparkSession, "filter")
    blocks = rows.select("sha", "part").mapInArrow(_mark(size), "block long, once binary, twice binary").repartition("block").mapInArrow(_merge(size), "part int, block long, bits binary")
    blocks.repartition(slices, "part").write.partitionBy("part").parquet(path)
    return path


def read_slice(path: str, part: int, size: int) -> np.ndarray:
    """The bits of one slice; a slice in which nothing was seen twice has no folder."""
    from pyarrow import dataset, fs

    where, root = filesystem(path)
    bits = np.zeros(size // 8, np.uint8)
    root = f"{root}/part={part}"
    if where.get_file_info(root).type == fs.FileType.Directory:
        for batch in dataset.dataset(root, filesystem=where, format="parquet").to_batches(columns=["block", "bits"]):
            for block, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bits[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(x, np.uint8)
    return bits


def suspected(rows: DataFrame, path: str, size: int) -> DataFrame:
    """``rows`` with ``maybe``: false where the filter shows that the digest stands once."""

    def probe(batches):
        held, bits = -1, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, parts = _cells(batch.column("sha"), size), batch.column("part").to_numpy()
            maybe = np.zeros(len(parts), bool)
            for part in np.unique(parts).tolist():
                if part != held:
                    held, bits = part, read_slice(path, part, size)
                here = parts == part
                own = cells[here]
                maybe[here] = ((bits[own >> 3] >> (own & 7).astype(np.uint8)) & 1).all(axis=1)
            yield batch.append_column("maybe", pa.array(maybe))

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "row", "sha", "part").mapInArrow(probe, f"id {kind}, row long, sha binary, part int, maybe boolean").drop("part")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256): one row for each row of ``docs``."""
    slices, size = slices_for(docs.count())
    rows = digests(docs, id_col, text_col, row).withColumn("part", F.pmod(F.xxhash64("sha"), F.lit(slices)).cast("int"))
    rows = staged(rows, "digests", by=["part"] if slices > 1 else None)
    probed = suspected(rows, write_filter(rows, slices, size), size)
    alone = probed.filter("not maybe").select("id", "row", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    suspects = staged(probed.filter("maybe").drop("maybe"), "suspects")
    order = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("row").alias("row"))
    groups = staged(suspects.groupBy(F.col("sha").alias("g")).agg(F.min(order).alias("first"), F.count("*").alias("group_size")), "groups")
    # A hot group's rows must not meet in one task: groups of HOT rows or more, of which there are few, go to the rows.
    hot = broadcast_if_small(groups.filter(F.col("group_size") >= HOT), MAX_HOT)
    fields = ["id", "row", "sha", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept")]
    rest = suspects.join(hot.select("g"), F.col("sha") == F.col("g"), "left_anti").join(groups.filter(F.col("group_size") < HOT), F.col("sha") == F.col("g")).select(fields)
    copies = suspects.join(hot, F.col("sha") == F.col("g")).select(fields).unionByName(rest)
    return alone.unionByName(copies).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), "row")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps; only the numbers of dropped rows shuffle."""
    rows = numbered(docs)
    return without(rows, exact_dedup(rows, id_col, text_col, F.col(ROW)).filter("not kept").select("row"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("row")


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
QUERIES = {"op6_exact_dedup": op6_exact_dedup}
ORACLE = {"op6_exact_dedup": SQL}
