"""Toxicity by a character n-gram linear classifier on naive-Bayes-scaled features.

Features are character grams (GRAMS sizes, inside lower-cased words padded with a space), present or not in a text. Over all
labelled training rows a gram's log-count ratio is
r = log(((toxic with it + 1) / (toxic + 2)) / ((others with it + 1) / (others + 2))).
Every gram whose chi-square is SIGNIFICANT or more is a feature, so features grow with the labels. Each text's present features
are scaled by r, and a logistic regression with L2 penalty is fitted on at most about SAMPLE training texts (chosen by hash);
a feature that none of these holds takes the mean weight. A text's score is the sigmoid of the bias plus the sum over its
features of weight times r.

Grams are 64-bit hashes throughout. A text is an array of characters, and all its grams of a size are hashed, looked up and
counted at once; the features' sorted hashes and weights stand in a file in the shared folder, which workers map.

Defined cases: a null text counts as empty and scores the bias alone; without labelled rows, or with one class only, all
scores are the share of toxic labels (0 without labels); rows whose id is null learn nothing; of several labels of an id,
any toxic one counts; repeated rows get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import broadcast_if_small, crc_mod, filesystem, fresh_path, mapped, own, release, slices, staged, table, texts_of

GRAMS = (2, 3, 4, 5)
#: Chi-square from which a gram is a feature: one in a thousand that tells nothing reaches it.
SIGNIFICANT = 10.83
SAMPLE = 10_000
PENALTY, STEPS = 1.0, 40
#: Features in a block of the fit; characters taken at once; grams of texts that a counting task holds before it adds them up.
BLOCK, AT_ONCE, HELD = 1 << 19, 500_000, 1_500_000
#: Labels that are broadcast at most (16 bytes each); more of them join by shuffle.
MAX_LABELS = 1_000_000
SPACE = 32


@lru_cache(maxsize=1)
def _in_words() -> np.ndarray:
    """By character: whether words hold it (letters, digits, underscore)."""
    return np.array([chr(c).isalnum() or c == 95 for c in range(sys.maxunicode + 1)])


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, hash) of all grams in words of the texts, one size after another; places are those of ``joined``'s characters."""
    codes = joined(texts)
    word = codes != SPACE
    h = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    inside = np.ones(len(codes), bool)  # no space between a gram's first and last character
    for n in range(2, max(GRAMS) + 1):
        h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) + codes[n - 1 :] + np.uint64(1)
        h *= np.uint64(0x9E3779B97F4A7C15)
        inside = inside[:-1] & word[n - 2 : len(codes) - 1] if n > 2 else inside[:-1]
        if n in GRAMS:
            at = np.flatnonzero(inside if n > 2 else word[:-1] | word[1:])
            yield at, h[at]


def joined(texts: list[str]) -> np.ndarray:
    """The lower-cased texts' characters with one space for each that no word holds, and a space at each text's begin and end."""
    codes = np.frombuffer("".join([f" {x} " for x in texts]).encode("utf-32-le"), "<u4")
    return np.where(_in_words()[codes], codes, SPACE).astype(np.uint64)


def owners(texts: list[str]) -> np.ndarray:
    """The text of each of ``joined``'s characters."""
    return np.repeat(np.arange(len(texts), dtype=np.int64), [len(x) + 2 for x in texts])


def gram_key(gram: str) -> int:
    """The hash of one gram."""
    h = 0
    for k, c in enumerate(gram):
        h = ((h ^ h >> 29) + ord(c) + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    return h


def portions(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(first, lower-cased texts) of about AT_ONCE characters, one text at least."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text.lower())
        size += len(text)
        if size >= AT_ONCE:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


@dataclass
class Model:
    #: The file of the features' sorted hashes and then of their weights times log-count ratios.
    uri: str
    size: int
    bias: float

    def load(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, weights, marks): a hash that is a feature is marked at its low bits."""
        keys, weights = (mapped(self.uri)[: self.size], mapped(self.uri)[self.size :].view(np.float64)) if self.size else (np.zeros(0, np.uint64), np.zeros(0))
        return keys, weights, _marks(keys)


def _marks(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(max(1 << 16, 1 << int(16 * len(keys)).bit_length()), bool)
    out[(keys & np.uint64(len(out) - 1)).astype(np.int64)] = True
    return out


def present(texts: list[str], keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature): the features that each of the lower-cased texts holds, once each, by text."""
    owner, found = owners(texts), []
    for at, h in grams(texts):
        here = np.flatnonzero(marks[(h & np.uint64(len(marks) - 1)).astype(np.int64)])
        if len(here) and len(keys):
            h = h[here]
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            good = keys[k] == h
            found.append(np.unique(owner[at[here[good]]] * len(keys) + k[good]))
    every = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
    return every // max(1, len(keys)), every % max(1, len(keys))


def gram_counts(rows: DataFrame) -> DataFrame:
    """(gram, toxic, other): labelled texts of each class that hold the gram, by its hash; tasks pre-aggregate."""

    def added(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        every, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        return every, *(np.bincount(at, np.concatenate([x[c] for x in held]), len(every)).astype(np.int64) for c in (1, 2))

    def batch_of(x):
        return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1]), pa.array(x[2])], names=["gram", "toxic", "other"])

    def run(batches):
        own("toxicity")
        held, size = [], 0
        for part in slices(batches):
            toxic = np.array([bool(x) for x in part.column("toxic").to_pylist()], np.int64)
            for first, some in portions(texts_of(part)):
                owner = owners(some)
                for at, h in grams(some):
                    # A text's grams once each: sorted by text (as they stand) and hash.
                    mine = owner[at]
                    by = np.lexsort((h, mine))
                    h, mine = h[by], mine[by]
                    once = np.ones(len(h), bool)
                    once[1:] = (h[1:] != h[:-1]) | (mine[1:] != mine[:-1])
                    label = toxic[first + mine[once]]
                    held.append(added([(h[once], label, 1 - label)]))
                    size += len(held[-1][0])
                if size > HELD:
                    held = [added(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield batch_of(held[0])
                        held, size = [], 0
        if held:
            yield batch_of(added(held))
        held.clear()
        release()

    return rows.select("text", "toxic").mapInArrow(run, "gram long, toxic long, other long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def fit(x: list[bytes], y: np.ndarray, r: np.ndarray, kind: str = "<u2") -> tuple[np.ndarray, float]:
    """Weights and bias of the penalised logistic regression on r-scaled presence, by Newton steps with conjugate gradients.
    A row of ``x`` is the text's features as integers of ``kind``; products go through blocks of rows, so that memory stays near
    the rows' own bytes."""
    cols = np.frombuffer(b"".join(x), kind)
    ends = np.cumsum([len(row) // cols.itemsize for row in x])
    cuts = sorted({0, len(x), *np.searchsorted(ends, np.arange(BLOCK, len(cols), BLOCK)).tolist()})
    starts = np.r_[0, ends]
    blocks = [(a, b, cols[starts[a] : starts[b]], np.diff(starts[a : b + 1])) for a, b in zip(cuts, cuts[1:])]

    def forward(v: np.ndarray) -> np.ndarray:
        scaled = v[:-1] * r
        return v[-1] + np.concatenate([np.bincount(np.repeat(np.arange(b - a), n), scaled[c], b - a) for a, b, c, n in blocks])

    def backward(u: np.ndarray) -> np.ndarray:
        out = np.zeros(len(r))
        for a, b, c, n in blocks:
            out += np.bincount(c, np.repeat(u[a:b], n), len(r))
        return np.r_[out * r, u.sum()]

    penalty = np.r_[np.full(len(r), PENALTY), 1e-6]

    def loss(w: np.ndarray, z: np.ndarray) -> float:
        return float(np.logaddexp(0, z).sum() - y @ z + penalty @ (w * w) / 2)

    w = np.zeros(len(r) + 1)
    z = forward(w)
    now = loss(w, z)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        d = np.maximum(p * (1 - p), 1e-6)
        step, res = np.zeros_like(w), -(backward(p - y) + penalty * w)
        slope, q, rr = res, res.copy(), res @ res
        limit = 1e-4 * rr
        for _ in range(25):
            hq = backward(d * forward(q)) + penalty * q
            a = rr / max(q @ hq, 1e-300)
            step, res = step + a * q, res - a * hq
            new = res @ res
            if new <= limit:
                break
            q, rr = res + new / rr * q, new
        gain, along, rate = slope @ step, forward(step), 1.0
        while rate > 1e-6 and loss(w + rate * step, z + rate * along) > now - 1e-4 * rate * gain:
            rate /= 2
        w, z = w + rate * step, z + rate * along
        before, now = now, loss(w, z)
        if before - now <= 1e-7 * max(1.0, before):
            break
    return w[:-1], float(w[-1])


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, text, toxic) of the rows of ``docs`` that have a label."""
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(labels[id_col].alias("_id")).agg(F.max(F.col(label_col)).alias("toxic"))
    known = broadcast_if_small(staged(known, "labels"), MAX_LABELS)
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return source.join(known, source["id"] == known["_id"]).select("id", "text", "toxic")


def features_of(counts: DataFrame, n1: int, n0: int) -> DataFrame:
    """(gram, r): significant grams of ``gram_counts`` with their log-count ratios."""
    a, b = F.col("toxic").cast("double"), F.col("other").cast("double")
    df, n = a + b, float(n1 + n0)
    chi = (a * n0 - b * n1) * (a * n0 - b * n1) * n / (df * F.greatest(n - df, F.lit(1.0)) * n1 * n0)
    return counts.filter(chi >= SIGNIFICANT).select("gram", (F.log((a + 1) / (n1 + 2)) - F.log((b + 1) / (n0 + 2))).alias("r"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from all rows of ``docs`` that have a label in ``labels``."""
    spark = docs.sparkSession
    rows = labelled(docs, labels, id_col, text_col, label_col)
    classes = {bool(r.toxic): r.n for r in rows.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = classes.get(True, 0), classes.get(False, 0)
    if not n1 or not n0:
        share = n1 / max(1, n1 + n0)
        return Model("", 0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    best = features_of(staged(gram_counts(rows), "gram-counts"), n1, n0).toArrow()
    keys, r = best.column("gram").to_numpy().view(np.uint64), best.column("r").to_numpy()
    by = np.argsort(keys)
    keys, r = keys[by], r[by]
    model = Model(fresh_path(spark, "toxicity-features"), len(keys), 0.0)
    _write(model, keys, r)
    limit = int(min(1.0, SAMPLE / (n1 + n0)) * (1 << 32))
    some = rows.filter(F.crc32(F.concat(F.lit("fit"), F.col("id").cast("string")).cast("binary")) < limit)

    def features(batches):
        own("toxicity")
        keys, _, marks = model.load()
        for part in slices(batches):
            x = []
            for _, some in portions(texts_of(part)):
                owner, k = present(some, keys, marks)
                cuts = np.searchsorted(owner, np.arange(len(some) + 1)).tolist()
                x += [k[a:b].astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(part.column("toxic").to_pylist(), pa.int32()), pa.array(x, pa.binary())], names=["id", "toxic", "x"])
        release()

    got = sorted(some.mapInArrow(features, f"id {some.schema['id'].dataType.simpleString()}, toxic int, x binary").collect(), key=lambda q: (q.id, q.x))
    x = [bytes(q.x) for q in got]
    w, bias = fit(x, np.array([q.toxic > 0 for q in got], float), r, "<u4")
    seen = np.zeros(len(w), bool)
    seen[np.frombuffer(b"".join(x), "<u4")] = True
    if seen.any():
        w[~seen] = max(0.0, w[seen].mean())
    out = Model(fresh_path(spark, "toxicity-model"), len(keys), bias)
    _write(out, keys, w * r)
    return out


def _write(model: Model, keys: np.ndarray, values: np.ndarray) -> None:
    fs, path = filesystem(model.uri)
    with fs.open_output_stream(path) as sink:
        sink.write(keys.tobytes())
        sink.write(values.astype(np.float64).tobytes())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own("toxicity")
        keys, weights, marks = model.load()
        for part in slices(batches):
            z = []
            for _, some in portions(texts_of(part)):
                owner, k = present(some, keys, marks)
                z.append(model.bias + np.bincount(owner, weights[k], len(some)))
            out = 1 / (1 + np.exp(-np.clip(np.concatenate(z), -500, 500)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.float64())], names=[id_col, "score"])
        release()

    return docs.select(docs[id_col], docs[text_col].alias("text")).mapInArrow(run, f"{id_col} {kind}, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(crc_mod("doc_id", 5) != 0), table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLE: dict[str, str] = {}
