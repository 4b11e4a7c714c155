"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, units and names are typed placeholders (slots), other words stay, lower-cased and
without punctuation at their ends. A capitalised word that begins a sentence is read both ways, as a word and as a name, and a small word between two parts of a
name belongs to it.
Windows of WINDOW template tokens are hashed and joined by hash with the windows of the benchmark's items; a window is taken
token by token and with each run of slots as one placeholder of its first slot's type. Windows with fewer than half plain
words tell nothing as templates: these are hashed with their literal values, so they match verbatim only.

A match must cover COVERAGE of an item's tokens, so of the windows that touch any stretch of more than the rest one must be
met. Each item is looked up by the windows of one such stretch, the one whose windows are rarest in the benchmark: a template
that many items share calls up those alone whose own words stand in the text too, and nothing is missed.

Matches of one document and item are chained: positions increase in both, and neighbours on different diagonals differ by at
most SHIFT tokens, so a word put in or left out does not part them. The slots of a chain are compared: the same value in the
item must stand for the same value in the document throughout, and the other way round; a run cut by a window's edge is
compared in the window that holds it whole. A document is contaminated by an item if a consistent chain covers at least
COVERAGE of the item's tokens; where slot values differ, the match is a re-parameterised question.

The benchmark's windows are a stated query set: they go to the rows as a broadcast hash table of at most MAX_WINDOWS
windows; a larger benchmark is taken in blocks of whole items of that size, one pass over the documents each. A text is made
into windows only if it holds, anywhere, all pairs of neighbouring plain words of a window that calls up an item.

Defined cases: null texts count as empty and match nothing; an item of fewer than WINDOW tokens has one window of all its
tokens; an item without word tokens matches nothing; null and repeated ids pass through, a row of results each; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh64_intdigest

from tidewater.llm.common import ROW, numbered, own, release, slices, table, texts_of, without

WINDOW, COVERAGE, SHIFT = 5, 0.8, 4
#: Windows a broadcast table holds at most (about 40 bytes each, and the items' texts).
MAX_WINDOWS = 1_000_000
#: Words that a task remembers; beyond that it starts anew.
CACHE_WORDS = 200_000
NUMBER, UNIT, NAME = SLOTS = "<number>", "<unit>", "<name>"
#: The hash of words that no item has.
UNKNOWN = 1
# Words for numbers and units of measure.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset("mm cm km kg mg ml cl kb mb gb tb hz khz mhz ghz kw kwh mph kph km/h m/s meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards gram grams kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees".split())

# Small words within names.
PARTICLES = frozenset("von van der den de del della di da dos du la le bin al el y".split())

_number = re.compile(r"[-+$€£#]?\d[\d.,:/]*(?:%|st|nd|rd|th)?").fullmatch
_runs = re.compile(r"[^\W_]+").findall
_odd = re.compile(r"[^\x00-\x7f\w]").search
_BLANK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_edge = re.compile(r"^[\W_]+|[\W_]+$")
_closes = re.compile(r"[.!?:;…][\"')\]]*$").search


def token_forms(word: str) -> tuple[str, str, str, bool]:
    """(template token within a sentence, the same at its start, value of a slot, whether the word ends a sentence)."""
    if word.isalnum():
        bare, ends = word, False
    elif word[:-1].isalnum():
        bare, ends = word[:-1], word[-1] in ".!?:;…"
    else:
        bare, ends = _edge.sub("", word), bool(_closes(word))
        if not bare:
            return "", "", "", ends
    low = bare.lower()
    if bare[0].isdecimal() and _number(bare) or low in NUMBER_WORDS:
        return NUMBER, NUMBER, low, ends
    if low in UNITS:
        return UNIT, UNIT, low, ends
    return (NAME if bare[0].isupper() else low), low, low, ends


def _hash(token: str) -> int:
    return xxh64_intdigest(token.encode(), 7)


_NAME = np.uint64(_hash(NAME))


@dataclass
class Tokens:
    """A text's tokens: hashes of the template tokens, of the tokens as they'd be within a sentence and of the words, whether each
    of the first and second is a slot, its word's place; and where the runs begin, which are single words or slots side by side,
    with the end, by the first and by the second."""

    template: np.ndarray
    shaped: np.ndarray
    literal: np.ndarray
    slot: np.ndarray
    heavy: np.ndarray
    kept: np.ndarray
    heads: np.ndarray
    wide: np.ndarray


class Canonical:
    """Texts to arrays of template tokens. ``known``: hashes of the words that matter; all others are one unknown word then."""

    def __init__(self, known: dict[str, int] | None = None):
        self.hash_of = _hash if known is None else lambda word: known.get(word, UNKNOWN)
        self._restart()

    def _restart(self):
        """Numbers of the words met, and by number hashes of the token within a sentence, of the one at its start and of the word
        itself, whether the first and second are slots, whether the word ends a sentence, and whether names can hold it."""
        self.numbers: dict[str, int] = {}
        self.forms, self.flags = np.zeros((3, 0), np.uint64), np.zeros((4, 0), bool)

    def _add(self, new: list[str]) -> None:
        forms, flags, slots = [], [], {x: _hash(x) for x in SLOTS}
        for word in new:
            inner, first, low, ends = token_forms(word)
            h = self.hash_of(low) if inner else 0
            forms += (slots.get(inner, h), slots.get(first, h), h)
            flags += (inner in slots, first in slots, ends, word in PARTICLES)
        first = len(self.numbers)
        room = max(2 * self.forms.shape[1], first + len(new)) - self.forms.shape[1] if first + len(new) > self.forms.shape[1] else 0
        if room:
            self.forms, self.flags = (np.concatenate([x, np.zeros((len(x), room), x.dtype)], axis=1) for x in (self.forms, self.flags))
        self.forms[:, first : first + len(new)] = np.array(forms, np.uint64).reshape(-1, 3).T
        self.flags[:, first : first + len(new)] = np.array(flags, bool).reshape(-1, 4).T
        self.numbers.update(zip(new, range(first, first + len(new))))

    def tokens(self, words: list[str], breaks: np.ndarray) -> Tokens:
        """The template tokens; words without letters or digits are left out. breaks: places at which a line begins."""
        if len(self.numbers) > CACHE_WORDS:
            self._restart()
        got = list(map(self.numbers.get, words))
        if None in got:
            self._add(list({w for w, k in zip(words, got) if k is None}))
            got = list(map(self.numbers.get, words))
        at = np.array(got, np.int64)
        starts = np.ones(len(at), bool)
        starts[1:] = self.flags[2, at[:-1]]
        starts[breaks[breaks < len(words)]] = True
        shaped = self.forms[0, at]
        kept = np.flatnonzero(shaped)
        at, starts, shaped = at[kept], starts[kept], shaped[kept]
        heavy = self.flags[0, at]
        slot = np.where(starts, self.flags[1, at], heavy)
        template = np.where(starts, self.forms[1, at], shaped)
        small = np.flatnonzero(self.flags[3, at])
        if len(small):
            name = heavy & ~self.flags[1, at]
            small = small[(small > 0) & (small < len(at) - 1)]
            small = small[name[small - 1] & name[small + 1] & ~starts[small] & ~starts[small + 1]]
            template[small] = shaped[small] = _NAME
            slot[small] = heavy[small] = True
        before = lambda x: np.concatenate([np.zeros(min(1, len(x)), bool), x[:-1]])
        heads, wide = (np.append(np.flatnonzero(~x | starts | ~before(x)), len(x)) for x in (slot, heavy))
        return Tokens(template, shaped, self.forms[2, at], slot, heavy, kept, heads, wide)


def runs(low: str) -> list[bytes]:
    """Runs of letters and digits of a lower-cased text; a sigma is the same at a word's end. Texts whose characters beyond ASCII
    are all letters or digits, nearly all, are cut as bytes."""
    low = low.replace("ς", "σ")
    if low.isascii() or not _odd(low):
        return low.encode().translate(_BLANK).split()
    return [x.encode() for x in _runs(low)]


def split(text: str) -> tuple[list[str], np.ndarray]:
    """(words, places at which a line begins)."""
    words, breaks = [], []
    for line in text.split("\n"):
        breaks.append(len(words))
        words += line.split()
    return words, np.array(breaks)


def _mixed(tokens: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = (out + tokens[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def _sums(x: np.ndarray, size: int) -> np.ndarray:
    """How many of each ``size`` neighbours are true."""
    sums = np.concatenate([np.zeros(1, np.int32), np.cumsum(x, dtype=np.int32)])
    return sums[size:] - sums[:-size]


def windows(t: Tokens, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, kind, start) of each window: by token (kind 0), by run (1, start is the run's number) where that differs, literally
    (2) where fewer than half of the tokens are plain words, and where a sentence's first word may be a name, with that reading by
    token (3) and by run (4)."""
    parts = []
    least, n = (size + 1) // 2, len(t.template)
    if n >= size:
        by_token = size - _sums(t.heavy, size)
        at = np.flatnonzero(size - _sums(t.slot, size) >= least)
        parts.append((_mixed(t.template, at, size), 0, at))
        at = np.flatnonzero(by_token < least)
        if len(at):
            parts.append((_mixed(t.literal, at, size) ^ np.uint64(0xA5A5A5A5A5A5A5A5), 2, at))
        either = t.heavy & ~t.slot
        if either.any():
            at = np.flatnonzero((_sums(either, size) > 0) & (by_token >= least))
            parts.append((_mixed(t.shaped, at, size), 3, at))
    for kind, tokens, slot, heads in ((1, t.template, t.slot, t.heads), (4, t.shaped, t.heavy, t.wide)):
        runs = len(heads) - 1
        if size <= runs < n:
            at = np.flatnonzero(heads[size:] - heads[:-size] > size)
            at = at[(size - _sums(slot[heads[:-1]], size))[at] >= least]
            if len(at):
                parts.append((_mixed(tokens[heads[:-1]], at, size), kind, at))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.concatenate([x for x, _, _ in parts]) + np.uint64(size if size < WINDOW else 0)
    return h, np.concatenate([np.full(len(x), kind) for x, kind, _ in parts]), np.concatenate([at for _, _, at in parts])


def spans_of(t: Tokens, kind: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First token and end of windows."""
    first, end = at.copy(), at + size
    for k, heads in ((1, t.heads), (4, t.wide)):
        here = kind == k
        first[here], end[here] = heads[at[here]], heads[at[here] + size]
    return first, end


def units(t: Tokens, kind: int, at: int, size: int) -> list[int]:
    """Where the tokens or runs of a window begin, with the end."""
    heads = t.heads if kind == 1 else t.wide if kind == 4 else None
    return list(range(at, at + size + 1)) if heads is None else heads[at : at + size + 1].tolist()


def pairs_of(own: Tokens, heads: set, q: list[int], there: Tokens, theirs: set, p: list[int]):
    """(start and end in the item, start and end in the text, whether the unit is whole in both) of a hit's units. q, p: where
    the units begin, with the end; tokens of one run on both sides make one unit."""
    out = []
    for i in range(len(q) - 1):
        if out and q[i] not in heads and p[i] not in theirs:
            qa, _, pa, _ = out[-1]
            out[-1] = (qa, q[i + 1], pa, p[i + 1])
        else:
            out.append((q[i], q[i + 1], p[i], p[i + 1]))
    return [(*x, x[0] in heads and x[1] in heads and x[2] in theirs and x[3] in theirs) for x in out]


def _needs(t: Tokens, values: list[str], size: int, h: np.ndarray, kind: np.ndarray, at: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[frozenset]:
    """What a text must hold for each window to stand in it: pairs of plain words side by side, and words that have no such neighbour."""
    out = []
    for k, a, b in zip(kind.tolist(), first.tolist(), end.tolist()):
        need, stretch = set(), []
        slot = t.heavy if k > 2 else t.slot
        for j in range(a, b + 1):
            if j < b and (k == 2 or not slot[j]):
                stretch += runs(values[j])
            elif stretch:
                need.update(zip(stretch, stretch[1:]) if len(stretch) > 1 else stretch)
                stretch = []
        out.append(frozenset(need))
    return out


class Block:
    """Part of the benchmark: its items' tokens, values and windows, and a sorted table of the hashes that call up items."""

    def __init__(self, items: list[tuple[object, str]]):
        canonical = Canonical()
        self.items, sizes, spans = [], set(), []
        for key, text in items:
            words, breaks = split(text)
            t = canonical.tokens(words, breaks)
            own = []
            # An item that is short by tokens or by runs has one window of all of them.
            for size in sorted({min(WINDOW, len(x)) for x in (t.template, t.heads[:-1], t.wide[:-1])} - {0}):
                h, kind, at = windows(t, size)
                if size < WINDOW:
                    runs = np.where(kind == 1, len(t.heads) - 1, np.where(kind == 4, len(t.wide) - 1, len(t.template)))
                    h, kind, at = h[runs == size], kind[runs == size], at[runs == size]
                sizes.add(size)
                own.append((size, h, kind, at, *spans_of(t, kind, at, size)))
            spans.append([np.concatenate([np.zeros(0, np.int64), *(x[c].astype(np.int64) for x in own)]) for c in (4, 5)] + [np.concatenate([np.zeros(0, np.uint64), *(x[1] for x in own)])])
            self.items.append((key, t, [token_forms(words[i])[2] for i in t.kept.tolist()], set(t.heads.tolist()), own))
        self.known = {w: _hash(w) for item in self.items for w in item[2]}
        self.sizes = sorted(sizes | {WINDOW})
        every, often = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for _, _, h in spans)]), return_counts=True)
        needs = [[need for part in item[4] for need in _needs(item[1], item[2], *part)] for item in self.items]
        weights = [often[np.searchsorted(every, x[2])] / np.array([16.0 ** len(n) for n in need]) for x, need in zip(spans, needs)]
        at = [self._rarest(len(item[1].template), *x[:2], w) for item, x, w in zip(self.items, spans, weights)]
        sets = {need[i] for need, some in zip(needs, at) for i in some.tolist()}
        frequent = Counter(x for need in sets for x in need)
        #: The parts of windows that call up items; by one part of each window, the rarest, the sets of all its parts.
        self.parts, self.needs = set(frequent), defaultdict(list)
        for need in sets:
            self.needs[min(need, key=lambda x: (frequent[x], str(x)))].append(need)
        called = [np.unique(x[2][some]) for x, some in zip(spans, at)]
        hashes = np.concatenate([np.zeros(0, np.uint64), *called])
        owners = np.repeat(np.arange(len(items)), [len(x) for x in called])
        by = np.argsort(hashes, kind="stable")
        self.hashes, self.owners = hashes[by], owners[by]
        self.low = np.zeros(1 << 20, bool)
        self.low[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    @staticmethod
    def _rarest(size: int, first: np.ndarray, end: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Places of the windows that touch the stretch whose windows are rarest; without any of them the rest is too little."""
        need = next((n for n in range(1, size + 1) if size - n < COVERAGE * size), 0)
        if not need or not len(weight):
            return np.arange(len(weight))
        begun = np.concatenate([[0], np.cumsum(np.bincount(first, weight, size))])
        over = np.cumsum(np.bincount(end, weight, size + 1))
        a = int(np.argmin(begun[need : size + 1] - over[: size - need + 1]))
        return np.flatnonzero((first < a + need) & (end > a))

    def calls(self, h: np.ndarray) -> np.ndarray:
        """Places in ``h`` of hashes that call up items."""
        likely = np.flatnonzero(self.low[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(likely) or not len(self.hashes):
            return likely[:0]
        at = np.minimum(np.searchsorted(self.hashes, h[likely]), len(self.hashes) - 1)
        return likely[self.hashes[at] == h[likely]]

    def likely(self, text: str) -> bool:
        """Whether a text holds, anywhere, all parts of a window that calls up an item; cheap, and never wrongly false."""
        words = runs(text.lower())
        here = self.parts.intersection(words)
        here |= self.parts.intersection(zip(words, words[1:]))
        return any(need <= here for key in here & self.needs.keys() for need in self.needs[key])

    def matches(self, words: list[str], t: Tokens):
        """(item's key, windows, coverage, changed slots, first word) of each contaminating item."""
        mine, wanted = {}, []
        for size in self.sizes:
            h, kind, at = windows(t, size)
            by = np.argsort(h, kind="stable")
            mine[size] = h[by], kind[by], at[by]
            wanted.append(h[self.calls(h)])
        wanted = np.unique(np.concatenate(wanted))
        first, last = np.searchsorted(self.hashes, wanted, "left"), np.searchsorted(self.hashes, wanted, "right")
        owners = np.unique(np.concatenate([np.zeros(0, np.int64), *(self.owners[a:b] for a, b in zip(first.tolist(), last.tolist()))]))
        found, theirs = [], set(t.heads.tolist()) if len(owners) else None
        for k in owners.tolist():
            key, own, values, heads, parts = self.items[k]
            size = len(own.template)
            # Where the item's windows stand in the text, and what those together cover at most.
            marks, ranges = np.zeros(size + 1, np.int64), []
            for n, h, kind, at, a, b in parts:
                low, high = np.searchsorted(mine[n][0], h, "left"), np.searchsorted(mine[n][0], h, "right")
                here = np.flatnonzero(high > low)
                np.add.at(marks, a[here], 1)
                np.add.at(marks, b[here], -1)
                ranges.append((n, kind[here].tolist(), at[here].tolist(), low[here].tolist(), high[here].tolist()))
            if (np.cumsum(marks) > 0).sum() < COVERAGE * size:
                continue
            spans = []
            for n, kind, at, low, high in ranges:
                _, kinds, places = mine[n]
                for own_kind, q, x, y in zip(kind, at, low, high):
                    q = units(own, own_kind, q, n)
                    spans += [(q, units(t, c, p, n)) for c, p in zip(kinds[x:y].tolist(), places[x:y].tolist())]
            best = None
            for chain in _chains([x for q, p in spans for x in pairs_of(own, heads, q, t, theirs, p)], size):
                covered = {i for qa, qb, _, _, _ in chain for i in range(qa, qb)}
                if len(covered) < COVERAGE * size:
                    continue
                changed = self._changed(words, t, own, values, chain)
                if changed is not None:
                    now = (len(covered) / size, -changed, -chain[0][2], chain)
                    best = now if best is None or now[:3] > best[:3] else best
            if best:
                inside = {x[:4] for x in best[3]}
                ends = {(x[0], x[2]) for x in inside}
                n = len({(q[0], p[0]) for q, p in spans if (q[0], p[0]) in ends})
                found.append((key, n, best[0], -best[1], int(t.kept[best[3][0][2]])))
        return found

    @staticmethod
    def _changed(words: list[str], t: Tokens, own: Tokens, values: list[str], chain) -> int | None:
        """How many slots have another value in the text; None where they are not consistent."""
        there, back, changed = {}, {}, 0
        for i, (qa, qb, pa, pb, whole) in enumerate(chain):
            if not own.heavy[qa]:
                continue
            mine, yours = values[qa:qb], [token_forms(words[int(w)])[2] for w in t.kept[pa:pb]]
            short, long = sorted((mine, yours), key=len)
            if len(short) < len(long) and short in (long[: len(short)], long[-len(short) :]):
                # Beside the item, or by a capital at its start, a run is longer on one side: nothing to compare.
                changed += len(mine) if 0 < i < len(chain) - 1 else 0
                continue
            if not whole and len(mine) != len(yours):
                changed += len(mine)
                continue
            each = zip(mine, yours) if len(mine) == len(yours) else [(" ".join(mine), " ".join(yours))]
            for x, y in each:
                if there.setdefault(x, y) != y or back.setdefault(y, x) != x:
                    return None
            if mine != yours:
                changed += sum(x != y for x, y in zip(mine, yours)) if len(mine) == len(yours) else len(mine)
        return changed


def _chains(pairs: list[tuple], size: int):
    """Chains of units: those of each diagonal alone, and, to each stretch of a diagonal, the best chain that ends in it."""
    widest: dict[tuple, tuple] = {}
    for x in pairs:
        for at in ((0, x[0], x[2]), (1, x[1], x[3])):
            if at not in widest or x[1] - x[0] + x[3] - x[2] > widest[at][1] - widest[at][0] + widest[at][3] - widest[at][2]:
                widest[at] = x
    kept = sorted((x for x in set(pairs) if widest[0, x[0], x[2]] == x == widest[1, x[1], x[3]]), key=lambda x: (x[2], x[0]))
    open_: dict[tuple, list] = {}
    parts: list[list] = []
    for x in kept:
        part = open_.pop((x[0], x[2]), None)
        if part is None:
            parts.append(part := [])
        part.append(x)
        open_[x[1], x[3]] = part
    diagonals: dict[int, list] = defaultdict(list)
    for part in parts:
        diagonals[part[0][2] - part[0][0]].append(part)
    yield from ([x for part in d for x in part] for d in diagonals.values())
    score, up, last = [], [], [(p[-1][1], p[-1][3]) for p in parts]
    for j, part in enumerate(parts):
        (qa, _, pa, _, _), (qe, pe) = part[0], last[j]
        best, via = qe - qa, None
        for i in range(j - 1, -1, -1):
            first = parts[i][0]
            if pa - first[2] > 2 * size + SHIFT * WINDOW:
                break
            qb, pb = last[i]
            if qa > first[0] and qe > qb and pa > first[2] and pe > pb and abs((pa - qa) - (pb - qb)) <= SHIFT and score[i] + qe - max(qa, qb) > best:
                best, via = score[i] + qe - max(qa, qb), i
        score.append(best)
        up.append(via)
    for j, n in enumerate(score):
        if n >= COVERAGE * size and up[j] is not None:
            chain, i = [], j
            while i is not None:
                chain, i = parts[i] + chain, up[i]
            yield chain


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text"):
    """The benchmark as blocks of at most MAX_WINDOWS windows (an item of more is a block of its own); one is held at a time."""
    held, size = [], 0
    for r in benchmark.select(benchmark[item_col].alias("k"), benchmark[text_col].alias("t")).toLocalIterator():
        n = len((r.t or "").split())
        if held and size + n > MAX_WINDOWS:
            yield Block(held)
            held, size = [], 0
        held.append((r.k, r.t or ""))
        size += n
    if held:
        yield Block(held)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, n_windows, coverage, changed_slots, first_word): a row for each document and item that contaminates it."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = f"{id_col} {kind}, {item_col} {item_kind}, n_windows int, coverage double, changed_slots int, first_word long"
    rows = docs.select(docs[id_col], docs[text_col].alias("text"))
    out = None
    for block in blocks(benchmark, item_col, item_text_col):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            own("decontam")
            block = held.value
            canonical = Canonical(block.known)
            for part in slices(batches):
                found, at = [], []
                for i, text in enumerate(texts_of(part)):
                    if not block.likely(text):
                        continue
                    words, breaks = split(text)
                    for m in block.matches(words, canonical.tokens(words, breaks)):
                        found.append(m)
                        at.append(i)
                if found:
                    cols = list(zip(*found))
                    arrays = [part.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], item_type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, names=[id_col, item_col, "n_windows", "coverage", "changed_slots", "first_word"])
            del canonical
            release()

        now = rows.mapInArrow(run, schema)
        out = now if out is None else out.unionByName(now)
    return spark.createDataFrame([], schema) if out is None else out


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates."""
    rows = numbered(docs)
    return without(rows, contaminated(rows, benchmark, ROW).select(ROW))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_decontamination": op8_decontamination}
ORACLE: dict[str, str] = {}
