"""Token-id files: fixed-width bit packing with block offsets.

A shard file is little-endian: an 8-byte magic, u32 bits an id, u32 ids a block; the blocks, each packed with the fewest
bits that hold the vocabulary and padded to whole bytes; then the index: i64 document ids, u64 first token of each
document (one more at the end), u64 byte offset of each block (one more at the end); then u64 documents, u64 tokens,
u64 blocks and the magic again. Any document is found by index and any block unpacks by itself with numpy.

Documents are dealt by ranges of their ids and sorted, so the files in order hold all documents in ascending order. Each
task writes files with names of its own and returns them as rows; files of lost or repeated attempts are never read.

Defined cases: a null text counts as empty and holds the end id alone; null ids come first and read back as null; rows of
equal id are ordered by text; an empty table makes no files; other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import WordCache, filesystem, fresh_path, own, slices, table, texts_of

MAGIC = b"TWTOKEN1"
BLOCK_IDS = 1 << 16
#: Stands for a null document id in a file.
NO_ID = -(1 << 63)
#: Bytes of a worker's cache of encoded pieces of text, and the longest that is cached.
CACHE_BYTES, CACHE_LENGTH = 224 << 20, 40


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Pack with ``bits`` bits an id, low bits first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_ids(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    spread = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return (spread.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


class ShardWriter:
    """Writes one shard file; holds one block of ids and the index."""

    def __init__(self, sink, bits: int, block_ids: int = BLOCK_IDS):
        self.sink, self.bits, self.block_ids = sink, bits, block_ids
        self.at = sink.write(MAGIC + struct.pack("<II", bits, block_ids)) and 16
        self.ids, self.firsts, self.blocks, self.tokens = [], [], [16], 0
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.firsts.append(self.tokens)
        self.tokens += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            every = np.concatenate(self.held)
            for k in range(0, len(every) - self.block_ids + 1, self.block_ids):
                self._block(every[k : k + self.block_ids])
            self.n_held = len(every) % self.block_ids
            self.held = [every[len(every) - self.n_held :]]

    def _block(self, ids: np.ndarray) -> None:
        data = pack_ids(ids, self.bits)
        self.sink.write(data)
        self.blocks.append(self.blocks[-1] + len(data))

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        for values, kind in ((self.ids, "<i8"), ([*self.firsts, self.tokens], "<u8"), (self.blocks, "<u8")):
            self.sink.write(np.array(values, kind).tobytes())
        self.sink.write(struct.pack("<QQQ", len(self.ids), self.tokens, len(self.blocks) - 1) + MAGIC)
        self.sink.close()


class ShardReader:
    """Random access to a shard file: ``tokens(a, b)`` reads only the blocks that hold them."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        head, tail = self._read(0, 16), self._read(size - 32, 32)
        if head[:8] != MAGIC or tail[24:] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block_ids = struct.unpack("<II", head[8:])
        self.n_docs, self.n_tokens, n_blocks = struct.unpack("<QQQ", tail[:24])
        index = self._read(size - 32 - 8 * (2 * self.n_docs + 1 + n_blocks + 1), 8 * (2 * self.n_docs + 1 + n_blocks + 1))
        self.ids = np.frombuffer(index, "<i8", self.n_docs)
        self.firsts = np.frombuffer(index, "<u8", self.n_docs + 1, 8 * self.n_docs).astype(np.int64)
        self.blocks = np.frombuffer(index, "<u8", n_blocks + 1, 8 * (2 * self.n_docs + 1)).astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def tokens(self, first: int, end: int) -> np.ndarray:
        if end <= first:
            return np.zeros(0, "<u4")
        a, b = first // self.block_ids, (end - 1) // self.block_ids + 1
        data = self._read(int(self.blocks[a]), int(self.blocks[b] - self.blocks[a]))
        out = []
        for k in range(a, b):
            n = min(self.block_ids, self.n_tokens - k * self.block_ids)
            out.append(unpack_ids(data[self.blocks[k] - self.blocks[a] : self.blocks[k + 1] - self.blocks[a]], self.bits, n))
        return np.concatenate(out)[first - a * self.block_ids : end - a * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.firsts[k]), int(self.firsts[k + 1]))


class Encoder:
    """Encodes with the tokenizers library. Texts are cut where the byte-level pre-tokenizer always cuts (before a space that
    a non-space follows; between a letter and a stop; around the last of a run of white space), and parts met again are taken from a bounded cache."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.cache = WordCache(CACHE_BYTES)
        self.cut = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[.,;:!?\s]|\Z)| ?\S+|\s+(?=\s\S)|\s+\Z|\s").findall
        #: Added tokens are found across parts, and the control characters are white space to one regex engine alone: such texts go whole.
        special = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()}, key=len, reverse=True)
        self.whole = re.compile("|".join([r"[\x1c-\x1f]", *map(re.escape, special)])).search
        #: One of these is in any such text.
        self.firsts = sorted({*"\x1c\x1d\x1e\x1f", *(x[:1] for x in special)})

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cache, parts = self.cache, [() if any(map(t.__contains__, self.firsts)) and self.whole(t) else self.cut(t) for t in texts]
        flat = list(itertools.chain.from_iterable(parts))
        got = list(map(cache.get, flat))
        gaps = [i for i, v in enumerate(got) if v is None]
        new, old = {flat[i] for i in gaps}, cache.old
        again = {x: old[x] for x in new if x in old}
        new, fresh = list(new.difference(again)), {}
        for k in range(0, len(new), 1 << 14):
            some = new[k : k + (1 << 14)]
            e = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(e.ids, "<u4").tobytes()
            ends = (np.searchsorted(np.array(e.word_ids), np.arange(1, len(some) + 1)) * 4).tolist()
            fresh.update(zip(some, (ids[a:b] for a, b in zip([0, *ends], ends))))
        known = again | fresh
        for i in gaps:
            got[i] = known[flat[i]]
        for x in [x for x in fresh if len(x) > CACHE_LENGTH]:
            del known[x]
        cache.keep_all(known)
        ends = itertools.accumulate(map(len, parts), initial=0)
        return [b"".join(got[a:b]) if b > a else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t, (a, b) in zip(texts, itertools.pairwise(ends))]


@lru_cache(maxsize=2)
def encoder(path: str | None) -> Encoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Encoder(path)


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, tokenizer_path: str | None = None, shards: int | None = None) -> list[tuple[str, int, int]]:
    """Write shard files under ``path``; returns (file, documents, tokens) of each, in order. The list has a row a file."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    dealt = rows.repartitionByRange(shards, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def run(batches):
        enc = encoder(tokenizer_path)
        own("tokens", enc.cache)
        bits = max(1, (max(enc.size, (end_id or 0) + 1) - 1).bit_length())
        writer, where, first = None, "", None
        for part in slices(batches, max_bytes=2 << 20):
            if writer is None:
                fs, root = filesystem(path)
                fs.create_dir(root, recursive=True)
                where = f"{uuid.uuid4().hex}.tok"
                writer = ShardWriter(fs.open_output_stream(f"{root}/{where}"), bits)
                first = part.column(0)[0].as_py()
            tail = b"" if end_id is None else struct.pack("<I", end_id)
            for key, data in zip(part.column(0).to_pylist(), enc.encode_bytes(texts_of(part))):
                writer.add(key, np.frombuffer(data + tail, "<u4"))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) if x is not None else pa.array([None], pa.int64()) for x in (first, where, len(writer.ids), writer.tokens)], names=["first", "file", "docs", "tokens"])

    out = dealt.mapInArrow(run, "first long, file string, docs long, tokens long").collect()
    out.sort(key=lambda r: NO_ID if r.first is None else r.first)
    return [(f"{path}/{r.file}", r.docs, r.tokens) for r in out]


def read_tokens(spark: SparkSession, files: list[tuple[str, int, int]], with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of all documents; start counts the ids of all documents in files before it."""
    starts = [0, *itertools.accumulate(t for _, _, t in files)]
    jobs = [(f, s) for (f, _, _), s in zip(files, starts)]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    if not jobs:
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for file, base in zip(*(c.to_pylist() for c in batch.columns)):
                fs, at = filesystem(file)
                with fs.open_input_file(at) as source:
                    shard = ShardReader(source)
                    step = 2048
                    for a in range(0, shard.n_docs, step):
                        b = min(shard.n_docs, a + step)
                        got = [shard.document(k) for k in range(a, b)] if shard.n_tokens > 1 << 26 else None
                        if got is None:
                            lo, hi = int(shard.firsts[a]), int(shard.firsts[b])
                            every = shard.tokens(lo, hi)
                            got = [every[shard.firsts[k] - lo : shard.firsts[k + 1] - lo] for k in range(a, b)]
                        cols = [
                            pa.array([None if k == NO_ID else k for k in shard.ids[a:b].tolist()], pa.int64()),
                            pa.array(shard.firsts[a:b] + base),
                            pa.array(np.diff(shard.firsts[a : b + 1])),
                            pa.array([zlib.crc32(np.ascontiguousarray(x, "<u4").tobytes()) for x in got], pa.int64()),
                        ]
                        if with_ids:
                            cols.append(pa.array([np.ascontiguousarray(x, "<u4").tobytes() for x in got], pa.binary()))
                        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return spark.createDataFrame(jobs, "file string, base long").repartition(len(jobs)).mapInArrow(run, schema)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_tokens(table(spark, sf_dir, "documents"), fresh_path(spark, "tokens"))
    return read_tokens(spark, files)


QUERIES = {"op1_token_files": op1_token_files}
ORACLE: dict[str, str] = {}
