"""SentencePiece (BPE) encoding and decoding.

Exact merge-type encoding by backtracking. One Aho-Corasick pass gives the pieces that start at each place; the encoder
takes the longest and steps back to shorter ones where two neighbours are not what merging their joined text gives back
(checked by re-merging, each pair once) or where the rest is known to fail (a bitfield of places). As neighbours' checks
are local, a sequence that passes them all is the one that merging yields.

Texts are cut where no piece can span (before a run of word marks, at line ends), and words met again are looked up in caches
of bounded bytes that go when the worker turns to another operator, so memory does not grow with the vocabulary of the corpus.

Defined cases: a null text counts as empty and gives begin and end ids only; unknown characters become byte pieces; null
and repeated ids are passed through row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.common import WordCache, own, slices, table, texts_of

MARK = "▁"
#: Bytes of a task's caches of words and of parts, the longest word that is cached, and the pairs of pieces remembered.
CACHE_BYTES, CACHE_LENGTH, PAIRS = 72 << 20, 48, 200_000


class PieceEncoder:
    """Encodes with a SentencePiece BPE model as the library does (identity normaliser, dummy prefix, byte fallback)."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.bytes_at = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.piece = {i: sp.id_to_piece(i) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.id = {x: i for i, x in self.piece.items()}
        self.score = {x: sp.get_score(i) for x, i in self.id.items()}
        if any("\n" in x or MARK in x.lstrip(MARK) for x in self.id):
            raise ValueError("a piece spans words or lines; texts of this model cannot be cut at them")
        self.automaton = ahocorasick.Automaton()
        for x, i in self.id.items():
            self.automaton.add_word(x, (len(x) - 1, i))
        self.automaton.make_automaton()
        self.length = {i: len(x) for i, x in self.piece.items()}
        #: For each piece, the longest piece that begins it, to step back to; -1: a single character stands there.
        self.shorter = {i: next((self.id[x[:k]] for k in range(len(x) - 1, 0, -1) if x[:k] in self.id), -1 if len(x) > 1 else None) for i, x in self.piece.items()}
        #: Neighbouring characters that some piece holds; elsewhere a text may be cut.
        self.inside = {x[k : k + 2] for x in self.id for k in range(len(x) - 1)}
        self.pairs: dict[int, bool] = {}
        self.words, self.parts = WordCache(CACHE_BYTES), WordCache(CACHE_BYTES // 3)
        self.find = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall

    def merged(self, text: str) -> list[str]:
        """Plain merging: the best-scored neighbours first, the leftmost of equals."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        out = self.pairs.get(key)
        if out is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            a, b = self.piece[left], self.piece[right]
            out = self.pairs[key] = self.merged(a + b) == [a, b]
        return out

    def encode_word(self, word: str) -> list[int]:
        """Ids of a stretch that no piece crosses. While searching, -1 is a character without a piece."""
        n = len(word)
        length, pairs = self.length, self.pairs
        # Longest matches one after the other; most words need no step back, and a cover that passes all checks is the result.
        path, at, last = [], 0, -1
        for end, (back, i) in self.automaton.iter_long(word):
            if end - back != at:
                break
            if last >= 0:
                fits = pairs.get(last << 32 | i)
                if not (self.compatible(last, i) if fits is None else fits):
                    break
            path.append(i)
            at, last = end + 1, i
        else:
            if at == n:
                return path
        longest = [-1] * n
        for end, (back, i) in self.automaton.iter(word):
            longest[end - back] = i
        shorter = self.shorter
        failed = 0
        path = []
        places: list[int] = []
        at, piece, last = 0, longest[0], -1
        while True:
            while piece is not None:
                end = at + (length[piece] if piece >= 0 else 1)
                if not failed >> end & 1:
                    if last < 0 or piece < 0:
                        break
                    fits = pairs.get(last << 32 | piece)
                    if fits is None:
                        fits = self.compatible(last, piece)
                    if fits:
                        break
                piece = shorter[piece] if piece >= 0 else None
            if piece is not None:
                path.append(piece)
                places.append(at)
                at, last = end, piece
                if at >= n:
                    break
                piece = longest[at]
            else:
                failed |= 1 << at
                at, piece = places.pop(), path.pop()
                last = path[-1] if path else -1
                piece = shorter[piece] if piece >= 0 else None
        if -1 not in path:
            return path
        out: list[int] = []
        for place, i in zip(places, path):
            out += [i] if i >= 0 else [self.bytes_at[b] for b in word[place].encode()]
        return out

    def _word(self, word: str) -> bytes:
        """Ids of a word that isn't in the cache's newer half: cut where no piece holds both neighbours, parts cached too."""
        got = self.words.older(word)
        if got is not None:
            return got
        inside, known = self.inside, self.parts
        cuts = [0, *(k for k in range(1, len(word)) if word[k - 1 : k + 1] not in inside), len(word)]
        if len(cuts) == 2:
            ids = self.encode_word(word)
            got = pack(f"<{len(ids)}I", *ids)
            return self.words.keep(word, got) if len(word) <= CACHE_LENGTH else got
        out = []
        for a, b in zip(cuts, cuts[1:]):
            part = word[a:b]
            got = known.get(part) or known.older(part)
            if got is None:
                ids = self.encode_word(part)
                got = pack(f"<{len(ids)}I", *ids)
                if b - a <= CACHE_LENGTH:
                    known.keep(part, got)
            out.append(got)
        got = b"".join(out)
        return self.words.keep(word, got) if len(word) <= CACHE_LENGTH else got

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, without begin and end."""
        if not text:
            return b""
        words = self.words
        return b"".join([words.get(x) or self._word(x) for x in self.find(MARK + text.replace(" ", MARK))])

    def encode(self, text: str) -> list[int]:
        return [self.bos, *np.frombuffer(self.encode_bytes(text), "<u4").tolist(), self.eos]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)

    def drop(self) -> None:
        """Empty the caches."""
        for cache in (self.words, self.parts):
            cache.drop()
        self.pairs.clear()


@lru_cache(maxsize=2)
def encoder(path: str | None) -> PieceEncoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return PieceEncoder(path)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """(id, ids binary: little-endian unsigned 32-bit integers with begin and end, n_tokens)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(model_path)
        own("pieces", enc)
        first, last = np.array([enc.bos], "<u4").tobytes(), np.array([enc.eos], "<u4").tobytes()
        for part in slices(batches):
            out = [first + enc.encode_bytes(t) + last for t in texts_of(part)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary()), pa.array([len(x) // 4 for x in out], pa.int64())], names=[id_col, "ids", "n_tokens"])

    return _named(docs, id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids binary, n_tokens long")


def digest_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]): encodes, decodes the ids, and keeps digests of both."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(model_path)
        own("pieces", enc)
        first, last = np.array([enc.bos], "<u4").tobytes(), np.array([enc.eos], "<u4").tobytes()
        for part in slices(batches, max_bytes=2 << 20):
            raw = [first + enc.encode_bytes(t) + last for t in texts_of(part)]
            back = [enc.decode(np.frombuffer(x, "<u4").tolist()) for x in raw]
            sha = [[hashlib.sha256(x).hexdigest() for x in raw], [hashlib.sha256(x.encode()).hexdigest() for x in back]]
            cols = [part.column(0), pa.array([len(x) // 4 for x in raw], pa.int64()), *map(pa.array, sha), *([pa.array(raw, pa.binary())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    return _named(docs, id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col], docs[text_col].alias("text"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op5_pieces": op5_pieces}
ORACLE: dict[str, str] = {}
