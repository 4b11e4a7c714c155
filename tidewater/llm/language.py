"""Language identification with interpolated Kneser-Ney character models.

For each language, grams of up to ORDER characters inside words (padded, lower-cased, letters only) are counted over all
training documents. Lower orders use continuation counts, each order its own discount n1 / (n1 + 2 n2), and probabilities
are interpolated down to a uniform distribution, all by joins and aggregates over tables of grams. A language's order is a
sorted array of 64-bit gram hashes with log probabilities and back-off weights beside it; a look-up is a binary search. The
arrays stand in one file in the shared folder, which workers map, so that a worker holds only the pages that it reads. A
text's language has the lowest cross-entropy a character. The score is the posterior at a temperature fitted on the training documents; a text is rejected
where its cross-entropy is far above what training documents of its language show.

As contexts stop at word ends, a text's cross-entropy is a sum over its words, so words met again come from a cache.

Every gram is kept: the file grows with the kinds of grams, 16 bytes each; the driver holds the numbers of one language at a
time to write it. Counts and the calibration cover all training documents; a language of fewer than ENOUGH of them is judged by the mean and spread pooled over languages.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and is rejected; without training documents all
texts are; equal cross-entropies go to the alphabetically first language; repeated rows get equal results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import ROW, crc_mod, filesystem, fresh_path, mapped, numbered, own, release, slices, staged, table, texts_of, without

ORDER = 4
#: A text is rejected where its cross-entropy is over the training documents' mean by this many standard deviations or nats,
#: whichever is more, and REJECT_SHORT over the root of its letters, as short texts scatter.
REJECT_SD, REJECT_NATS, REJECT_SHORT = 8.0, 0.75, 12.0
#: Training documents from which a language's own mean and deviation count; with fewer, those pooled over the languages do.
ENOUGH = 30
START, END = "\x02", "\x03"
#: Words and characters that a scoring task remembers, and words scored at once.
CACHE_WORDS, CACHE_CHARS, AT_ONCE = 200_000, 4_000_000, 8_000
#: Distinct words and characters that a counting task holds before it passes their grams on.
HELD, HELD_CHARS = 30_000, 500_000
#: Size of the alphabet for the uniform distribution below the first order.
ALPHABET = 1_000

_letters = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters; what the class takes for letters besides (superscripts, Roman numerals) makes no word alone."""
    words = _letters(text.lower())
    if not text.isascii():
        bare = {w for w in set(words) if not w.isalpha() and not any(map(str.isalpha, w))}
        if bare:
            words = [w for w in words if w not in bare]
    return words


def gram_rows(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): grams of ORDER characters of (lang, text) rows; each task pre-aggregates."""

    def flush(held: dict[str, Counter]):
        for lang, words in held.items():
            if not words:
                continue
            codes, at, owner = coded(list(words))
            letters, number = np.unique(codes, return_inverse=True)
            # A gram as one number: its characters' numbers among those met, as digits; sixteen bits hold all but exotic mixes.
            if len(letters) <= 1 << 16:
                packed = sum(number[at - k].astype(np.uint64) << np.uint64(16 * k) for k in range(ORDER))
            else:
                packed = hashes(codes, at, ORDER)
            _, first, place = np.unique(packed, return_index=True, return_inverse=True)
            n = np.bincount(place, np.fromiter(words.values(), float, len(words))[owner])
            ends = at[first]
            grams = np.ascontiguousarray(np.stack([codes[ends - k] for k in range(ORDER - 1, -1, -1)], axis=1).astype("<u4")).view(f"<U{ORDER}").ravel()
            words.clear()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.tolist(), pa.string()), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    def run(batches):
        own("language")
        held: dict[str, Counter] = {}
        chars = 0
        for part in slices(batches, max_bytes=1 << 20):
            for lang, text in zip(part.column("lang").to_pylist(), texts_of(part)):
                held.setdefault(lang, Counter()).update(words_of(text))
                chars += len(text)
                # Few distinct words can take many characters, and the other way round.
                if chars > HELD_CHARS and (sum(map(len, held.values())) > HELD or (chars := sum(len(w) for words in held.values() for w in words)) > HELD_CHARS):
                    yield from flush(held)
                    chars = 0
        yield from flush(held)
        release()

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def hashes(codes: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """64-bit hashes of the ``order`` codes that end at each place."""
    out = np.zeros(len(at), np.uint64)
    for k in range(order - 1, -1, -1):
        out = (out + codes[at - k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all padded words, places to predict, the word of each)."""
    joined = "".join(START * (ORDER - 1) + w + END for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(sizes + ORDER - 1) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    return codes, at, owner


@dataclass
class Table:
    """One language's grams of one order: sorted hashes, log probabilities; of contexts: sorted hashes, log back-off weights."""

    keys: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in the sorted keys, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Model:
    langs: list[str]
    #: The file with all arrays, and by language and order how many grams and contexts stand there.
    uri: str = ""
    sizes: list[list[tuple[int, int]]] = field(default_factory=list)
    #: Of each language's training documents: mean and standard deviation of the cross-entropy under its own model.
    usual: np.ndarray | None = None
    temperature: float = 1.0

    @property
    def tables(self) -> list[list[Table]]:
        out, at = [], 0
        for orders in self.sizes:
            out.append([])
            for grams, contexts in orders:
                ends = np.cumsum([at, grams, grams, contexts, contexts])
                keys, logp, ctx, back = (mapped(self.uri)[a:b] for a, b in zip(ends, ends[1:]))
                out[-1].append(Table(keys, logp.view(np.float64), ctx, back.view(np.float64)))
                at = int(ends[-1])
        return out

    def log_probabilities(self, words: list[str], tables: list[list[Table]] | None = None) -> np.ndarray:
        """Natural log probability of each word, with its end, under each language."""
        codes, at, owner = coded(words)
        # Each kind of gram is looked up once, in order.
        kinds = lambda place, k: np.unique(hashes(codes, place, k), return_inverse=True)
        grams = [kinds(at, k) for k in range(1, ORDER + 1)]
        before = [None, *(kinds(at - 1, k) for k in range(1, ORDER))]
        out = np.empty((len(words), len(self.langs)))
        for j, orders in enumerate(tables or self.tables):
            logp = np.full(len(at), -np.log(ALPHABET))
            for t, (own, place), context in zip(orders, grams, before):
                if context is None:
                    back = t.backoff[0]
                else:
                    c = _find(t.contexts, context[0])
                    back = (np.where(c >= 0, t.backoff[c], 0.0) if len(t.contexts) else np.zeros(len(c)))[context[1]]
                found = _find(t.keys, own)
                value = t.logp[found] if len(t.keys) else np.zeros(len(found))
                logp = np.where((found >= 0)[place], value[place], logp + back)
            out[:, j] = np.bincount(owner, logp, len(words))
        return out


def probabilities(counts: DataFrame) -> DataFrame:
    """(lang, k, kind, item, value) of (lang, gram, n) rows of ORDER characters: by order k, grams (kind 0) with log probabilities
    and contexts (kind 1) with log back-off weights. Each order is a few equi-joins and partial aggregates on grams."""
    levels = [counts]
    for k in range(ORDER - 1, 0, -1):  # continuation counts: in how many kinds of longer grams it ends
        levels.insert(0, staged(levels[0].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), f"grams-{k}"))
    out, lower = None, None
    for k, level in enumerate(levels, 1):
        once, twice = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discount = level.groupBy("lang").agg(F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(0.5).alias("d"))
        totals = level.groupBy("lang", F.substring("gram", 1, k - 1).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        contexts = staged(totals.join(discount, "lang").select("lang", "context", "total", "d", (F.col("d") * F.col("kinds") / F.col("total")).alias("weight")), f"contexts-{k}")
        rows = level.withColumn("context", F.substring("gram", 1, k - 1)).join(contexts, ["lang", "context"])
        if lower is None:
            rows = rows.withColumn("below", F.lit(1 / ALPHABET))
        else:
            rows = rows.withColumn("rest", F.substring("gram", 2, k - 1)).join(lower.select("lang", F.col("gram").alias("rest"), F.col("p").alias("below")), ["lang", "rest"])
        p = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("below")
        lower = staged(rows.select("lang", "gram", p.alias("p")), f"probabilities-{k}")
        for kind, part, item, value in ((0, lower, "gram", "p"), (1, contexts, "context", "weight")):
            part = part.select("lang", F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.col(item).alias("item"), F.log(value).alias("value"))
            out = part if out is None else out.unionByName(part)
    return out


def _keyed(rows: DataFrame) -> DataFrame:
    """(lang, k, kind, key, value): items of ``probabilities`` by their hash."""

    def run(batches):
        for batch in batches:
            items = batch.column("item").to_pylist()
            size = np.fromiter(map(len, items), np.int64, len(items))
            keys = np.zeros(len(items), np.uint64)
            for n in set(size.tolist()) - {0}:
                here = np.flatnonzero(size == n)
                codes = np.frombuffer("".join([items[i] for i in here.tolist()]).encode("utf-32-le"), "<u4").astype(np.uint64)
                keys[here] = hashes(codes, np.arange(len(here)) * n + n - 1, n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "k", "kind")), pa.array(keys.view(np.int64)), batch.column("value")], names=["lang", "k", "kind", "key", "value"])

    return rows.mapInArrow(run, "lang string, k int, kind int, key long, value double")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count grams over all rows with a language and a text, then fit score and rejection on all of them."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    model = _counted(rows)
    if model.langs:
        _calibrate(model, cross_entropies(rows, model, keep="lang"))
    return model


def _counted(rows: DataFrame) -> Model:
    """The model of (text, lang) rows, not calibrated."""
    spark = rows.sparkSession
    counts = staged(gram_rows(rows), "grams")
    model = Model(sorted(r.lang for r in counts.select("lang").distinct().collect()), fresh_path(spark, "language-model"))
    if not model.langs:
        return model
    # By language, as the driver reads them.
    every = staged(_keyed(probabilities(counts)), "keyed", by=["lang"])
    fs, path = filesystem(model.uri)
    with fs.open_output_stream(path) as sink:
        for lang in model.langs:
            part = every.filter(F.col("lang") == lang).select("k", "kind", "key", "value").toArrow()
            k, kind, key, value = (part.column(c).to_numpy() for c in ("k", "kind", "key", "value"))
            key, sizes = key.view(np.uint64), []
            for order in range(1, ORDER + 1):
                for what in (0, 1):
                    here = np.flatnonzero((k == order) & (kind == what))
                    here = here[np.argsort(key[here])]
                    sink.write(key[here].tobytes())
                    sink.write(value[here].tobytes())
                    sizes.append(len(here))
            model.sizes.append(list(zip(sizes[::2], sizes[1::2])))
    return model


def identify(docs: DataFrame, training: Column, id_col: str = "doc_id") -> DataFrame:
    """``predict`` for all rows (id, text, lang) by a model of those where ``training`` holds; each text is scored once for
    calibration and prediction together."""
    learns = training & F.col("lang").isNotNull() & F.col("text").isNotNull()
    rows = docs.select(F.col(id_col).alias("id"), "text", F.when(learns, F.col("lang")).alias("lang"))
    model = _counted(rows.filter("lang is not null"))
    if not model.langs:
        return predict(docs, model, id_col)
    scored = staged(cross_entropies(rows, model, keep="lang"), "scored")
    _calibrate(model, scored)
    return judged(scored, model, id_col)


def _calibrate(model: Model, scored: DataFrame) -> None:
    """Score and rejection from the cross-entropies of all training documents: rows of ``cross_entropies`` with ``kept`` the language."""
    place = {x: j for j, x in enumerate(model.langs)}
    grid = np.geomspace(0.5, 64, 29)
    width = len(model.langs)

    def run(batches):
        moments, loss = np.zeros((width, 3)), np.zeros((width, len(grid)))
        for batch in batches:
            truth = np.array([place.get(x, -1) for x in batch.column("kept").to_pylist()], int)
            h = batch.column("h").flatten().to_numpy().reshape(len(truth), width)[truth >= 0]
            truth = truth[truth >= 0]
            own = h[np.arange(len(truth)), truth]
            for i, x in enumerate((np.ones(len(own)), own, own * own)):
                moments[:, i] += np.bincount(truth, x, width)
            low = h.min(axis=1, keepdims=True)
            for i, t in enumerate(grid):
                loss[:, i] += np.bincount(truth, np.log(np.exp(-t * (h - low)).sum(axis=1)) + t * (own - low[:, 0]), width)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int64()), *map(pa.array, moments.T), pa.array(loss.tolist(), pa.list_(pa.float64()))], names=["j", "n", "s", "ss", "loss"])

    parts = scored.filter("kept is not null and letters > 0").select("kept", "h").mapInArrow(run, "j long, n double, s double, ss double, loss array<double>")
    got = parts.groupBy("j").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")], *[F.sum(F.col("loss")[i]).alias(f"loss{i}") for i in range(len(grid))]).orderBy("j").collect()
    moments = np.zeros((width, 3))
    for r in got:
        moments[r.j] = r.n, r.s, r.ss
    n, total = moments[:, 0], moments[:, 0].sum()
    if not total:
        return
    mean = moments[:, 1] / np.maximum(n, 1)
    within = np.maximum(moments[:, 2] - n * mean**2, 0)
    # Spread around each language's own mean; between languages it would be no spread of texts.
    pooled = moments[:, 1].sum() / total, np.sqrt(within.sum() / total)
    model.usual = np.array([[mean[j], np.sqrt(within[j] / n[j])] if n[j] >= ENOUGH else pooled for j in range(width)])
    model.temperature = float(grid[np.argmin([sum(r[f"loss{i}"] for r in got) for i in range(len(grid))])])


def cross_entropies(rows: DataFrame, model: Model, keep: str | None = None) -> DataFrame:
    """(id, kept, letters, h): nats a character under each language; ``letters`` counts characters and word ends."""
    kind = rows.schema["id"].dataType.simpleString()
    other = rows.schema[keep].dataType.simpleString() if keep else "string"

    def run(batches):
        own("language")
        tables, width = model.tables, len(model.langs)
        # Words by number; the numbers' log probabilities and lengths stand in two arrays.
        number: dict[str, int] = {}
        vectors, lengths, chars = np.zeros((CACHE_WORDS, width)), np.zeros(CACHE_WORDS), 0
        for part in slices(batches, max_bytes=1 << 20):
            docs = [words_of(t) for t in texts_of(part)]
            flat = list(chain.from_iterable(docs))
            got = list(map(number.get, flat))
            if None in got:
                new = list({w for w, k in zip(flat, got) if k is None})
                chars += sum(map(len, new))
                if len(number) + len(new) > len(lengths) or chars > CACHE_CHARS:
                    number.clear()
                    new = list(set(flat))
                    chars = sum(map(len, new))
                    if len(new) > len(lengths):
                        vectors, lengths = np.zeros((len(new), width)), np.zeros(len(new))
                first = len(number)
                for k in range(0, len(new), AT_ONCE):
                    some = new[k : k + AT_ONCE]
                    vectors[first + k : first + k + len(some)] = model.log_probabilities(some, tables)
                lengths[first : first + len(new)] = np.fromiter(map(len, new), float, len(new)) + 1
                number.update(zip(new, range(first, first + len(new))))
                got = list(map(number.get, flat))
            index = np.array(got, np.int64)
            owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
            letters = np.bincount(owner, lengths[index], len(docs))
            total = np.stack([np.bincount(owner, vectors[index, j], len(docs)) for j in range(width)], axis=1) if width else np.zeros((len(docs), 0))
            h = -total / np.maximum(letters, 1)[:, None]
            kept = part.column(2) if keep else pa.nulls(part.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), kept, pa.array(letters.astype(np.int64)), pa.array(h.tolist(), pa.list_(pa.float64()))], names=["id", "kept", "letters", "h"])
        number.clear()
        del vectors, lengths
        release()

    return rows.select("id", "text", *([keep] if keep else [])).mapInArrow(run, f"id {kind}, kept {other}, letters long, h array<double>")


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, cross_entropy, accepted)."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    if not model.langs:
        return rows.select(F.col("id").alias(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(False).alias("accepted"))
    return judged(cross_entropies(rows, model), model, id_col)


def judged(h: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score, cross_entropy, accepted) from rows of ``cross_entropies``."""
    limit = [float(m + max(REJECT_SD * s, REJECT_NATS)) for m, s in model.usual]
    names, limits = F.array(*map(F.lit, model.langs)), F.array(*map(F.lit, limit))
    known = F.col("letters") > 0
    low = F.array_min("h")
    weight = F.aggregate("h", F.lit(0.0), lambda acc, x: acc + F.exp(-model.temperature * (x - low)))
    best = F.array_position("h", low).cast("int")
    return h.select(
        F.col("id").alias(id_col),
        F.when(known, F.element_at(names, best)).otherwise("und").alias("lang_pred"),
        F.when(known, 1.0 / weight).otherwise(0.0).alias("score"),
        F.when(known, low).alias("cross_entropy"),
        F.when(known, low <= F.element_at(limits, best) + REJECT_SHORT / F.sqrt(F.col("letters"))).otherwise(False).alias("accepted"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return identify(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


def accepted_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is accepted by a model of the same rows that ``op2_language_id`` learns from."""
    rows = numbered(docs)
    return without(rows, identify(rows, F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(True)), ROW).filter("not accepted").select(ROW))


QUERIES = {"op2_language_id": op2_language_id}
ORACLE: dict[str, str] = {}
