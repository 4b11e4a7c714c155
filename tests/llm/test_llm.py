"""Training-data operators against brute force, libraries, and the edge cases of their docstrings."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import components, decontam, exact_dedup, language, licenses, pieces, sharding, simhash, token_files, toxicity, url_filter
from tidewater.llm.common import fresh_path, table

DOC = "doc_id long, text string, lang string, source string, n_chars long, row string, sha string, fp string, slot string, score string, label string"
LONG = "wort " * 30_000 + "x" * 40_000


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use inside."""
    texts = [None, "", " \t", "a", "a  b", "a b", LONG, LONG, "licensed under the MIT License", "日本語 text 😀", None]
    rows = [(i if i != 10 else None, t, "en" if i % 2 else None, "s", 0, "r", "s", "f", "s", "s", "l") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4]], DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def same(a, b):
    assert sorted(map(str, a)) == sorted(map(str, b))


# 1 token files


def test_packing_round_trip():
    for bits in (1, 3, 8, 13, 16, 17, 32):
        ids = np.random.default_rng(bits).integers(0, 1 << min(bits, 31), 1003).astype("<u4")
        assert (token_files.unpack_ids(token_files.pack_ids(ids, bits), bits, len(ids)) == ids).all()


def test_cached_encoding_equals_the_library():
    enc = token_files.encoder(None)
    random.seed(4)
    parts = ["a", "b", " ", "the", "\n", "\t", "é", "日", "😀", "\x00", "'s", "'ll", "1", ".", "<|endoftext|>", "\u00a0", "\x1c", "_", "  ", "Don't", "foo,bar"]
    many = ["".join(random.choice(parts) for _ in range(random.randrange(30))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_bytes(many)] == [e.ids for e in enc.tokenizer.encode_batch(many, add_special_tokens=False)]


def test_token_files_hold_all_documents_in_order(spark, texts, sf):
    rows = token_files.op1_token_files(spark, sf).orderBy("doc_id").collect()
    tok, start = token_files.encoder(None).tokenizer, 0
    assert [r.doc_id for r in rows] == sorted(texts)
    for r in rows:
        ids = [*tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_file_edges(spark, edges, none):
    files = token_files.write_tokens(edges, fresh_path(spark, "t"), shards=3)
    rows = token_files.read_tokens(spark, files, with_ids=True).orderBy("start").collect()
    assert len(rows) == 12 and rows[0].doc_id is None and rows[0].n_tokens == 1
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()
    assert token_files.write_tokens(none, fresh_path(spark, "t")) == [] and token_files.read_tokens(spark, []).count() == 0


def test_random_access(tmp_path):
    import pyarrow.fs as pfs

    fs, path = pfs.LocalFileSystem(), str(tmp_path / "x.tok")
    w = token_files.ShardWriter(fs.open_output_stream(path), 13, block_ids=7)
    held = [np.arange(n, dtype="<u4") * 3 for n in (0, 5, 20, 1, 7)]
    for i, x in enumerate(held):
        w.add(i, x)
    w.close()
    r = token_files.ShardReader(fs.open_input_file(path))
    assert all((r.document(k) == x).all() and len(r.document(k)) == len(x) for k, x in enumerate(held))
    assert r.tokens(4, 9).tolist() == np.concatenate(held)[4:9].tolist()


# 2 language


def test_language_on_held_out(spark, docs, sf):
    out = {r.doc_id: r for r in language.op2_language_id(spark, sf).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [k for k in truth if out[k].held_out]
    assert all(out[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in truth)
    assert np.mean([out[k].lang_pred == truth[k] for k in held]) >= 0.9
    assert all(0 <= r.score <= 1 for r in out.values())


def test_kneser_ney_matches_the_formula(spark):
    texts_ = ["banana bandana", "ban nab ban", "an ana banner"]
    model = language.train(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts_)], "doc_id long, text string, lang string"))
    pad = lambda w: language.START * (language.ORDER - 1) + w + language.END
    level = Counter(pad(w)[k : k + language.ORDER] for t in texts_ for w in t.split() for k in range(len(w) + 1))
    levels = [level]
    for _ in range(language.ORDER - 1):
        levels.insert(0, Counter(g[1:] for g in levels[0]))

    def p(gram):
        k = len(gram)
        counts = levels[k - 1]
        low = p(gram[1:]) if k > 1 else 1 / language.ALPHABET
        seen = [n for g, n in counts.items() if g[:-1] == gram[:-1]]
        if not seen:
            return low
        once, twice = (sum(n == m for n in counts.values()) for m in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        return max(counts.get(gram, 0) - d, 0) / sum(seen) + d * len(seen) / sum(seen) * low

    for w in ("ban", "banana", "nan", "zebra", "b", "bazan"):
        want = sum(np.log(p(pad(w)[k : k + language.ORDER])) for k in range(len(w) + 1))
        assert model.log_probabilities([w])[0, 0] == pytest.approx(want, rel=1e-9)


def test_every_gram_is_kept(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(25_000)]
    model = language.train(spark.createDataFrame([(0, " ".join(words), "x")], "doc_id long, text string, lang string"))
    pad = lambda w: language.START * (language.ORDER - 1) + w + language.END
    want = len({pad(w)[k : k + language.ORDER] for w in words for k in range(len(w) + 1)})
    assert want > 110_000 and len(model.tables[0][-1].keys) == want


def test_words_hold_a_letter():
    assert language.words_of("12² Ⅷ ½ m² É_x 3a") == ["m²", "é", "x", "a"]


def test_gibberish_is_rejected_and_text_kept(spark, docs):
    model = language.train(docs)
    rng = random.Random(3)
    junk = " ".join("".join(rng.choice("qxzjkvwpfg") for _ in range(8)) for _ in range(40))
    rows = spark.createDataFrame([(1, junk), (2, docs.filter("lang = 'de'").first().text)], "doc_id long, text string")
    assert {r.doc_id: r.accepted for r in language.predict(rows, model).collect()} == {1: False, 2: True}


def test_a_thin_language_among_many_documents_rejects_gibberish(spark, docs):
    some = docs.filter("n_chars < 600").select("text", "lang").crossJoin(spark.range(200)).select(F.monotonically_increasing_id().alias("doc_id"), "text", "lang")
    thin = next(k for k in range(1 << 60, 1 << 61) if zlib.crc32(f"calibrate{k}".encode()) > 0.97 * (1 << 32))
    one = spark.createDataFrame([(thin, "zolmek tavri ushpa kelo brinda moxu ferti wag quilo sdenor jyth", "xx")], "doc_id long, text string, lang string")
    assert some.count() > 4_200
    model = language.train(some.unionByName(one))
    rng = random.Random(5)
    junk = [(n, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(n))) for n in (100, 1_000)]
    out = language.predict(spark.createDataFrame([*junk, (0, one.first().text)], "doc_id long, text string"), model).collect()
    assert {r.doc_id: (r.lang_pred, r.accepted) for r in out} == {0: ("xx", True), 100: ("xx", False), 1_000: ("xx", False)}


def test_language_edges(spark, edges, none):
    model = language.train(edges)
    out = language.predict(edges, model).collect()
    assert len(out) == 12 and {r.lang_pred for r in out if r.doc_id in (0, 1, 2)} == {"und"}
    assert language.predict(none, model).count() == 0
    bare = language.predict(edges, language.train(none)).collect()
    assert {r.lang_pred for r in bare} == {"und"} and not any(r.accepted for r in bare)


# 3 simhash


def brute_components(fps):
    low = {}
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if bin(fps[a] ^ fps[b]).count("1") <= 4:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    for i in ids:
        low[i] = root(i)
    return low


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else ([" ".join(words)] if words else [])
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark, texts, sf):
    rows = {r.doc_id: r for r in simhash.op3_simhash(spark, sf).collect()}
    assert sorted(rows) == sorted(texts)
    some = random.Random(1).sample(sorted(texts), 40)
    assert all(int(rows[k].fingerprint, 16) == brute_fingerprint(texts[k]) for k in some)
    want = brute_components({k: int(r.fingerprint, 16) for k, r in rows.items()})
    assert {k: r.component_id for k, r in rows.items()} == want


@pytest.mark.parametrize("chunk,wide", [(512, 50_000_000), (5, 50_000_000), (512, 1)])
def test_links_of_a_dense_ball(spark, monkeypatch, chunk, wide):
    """Large buckets dealt out in chunks, and seven ranges, give the same components."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "WIDE", wide)
    monkeypatch.setattr(simhash, "FOREST", 500_000 if chunk == 512 else 10)
    rng = np.random.default_rng(7)
    fps = set()
    for centre in rng.integers(0, 1 << 62, 3).tolist():
        for _ in range(40):
            x = centre
            for b in rng.integers(0, 63, int(rng.integers(0, 7))).tolist():
                x ^= 1 << b
            fps.add(x)
    want = brute_components({x: x for x in fps})
    links = simhash.near_links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    got = {r.node: r.root for r in components.components(links).collect()}
    assert {x: got.get(x, x) for x in fps} == want


def test_simhash_edges(spark, edges, none):
    rows = simhash.simhash_groups(edges).collect()
    assert len(rows) == 12
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {0, 1, 2, None} and {r.component_id for r in zero} == {0}
    assert simhash.simhash_groups(none).count() == 0


def test_components_of_a_chain(spark):
    edges_ = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges_).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


# 4 licenses


def test_license_base_counts_match_brute_force(spark, texts, sf):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    for r in licenses.op4_licenses(spark, sf).collect():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r.doc_id] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for p, label in phrases.items() for k in range(len(words)) if tuple(words[k : k + len(p)]) == p]
        starts = [k for k, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_license_rules():
    labels = lambda t: [x[2] for x in licenses.detect(t)]
    assert labels("This is under the GNU Lesser General Public License v2.1 or later.") == ["lgpl"]
    assert labels("SPDX-License-Identifier: BSD-3-Clause") == ["bsd"]
    assert labels("Released under the\nMIT License") == ["mit"]
    assert labels("see http://www.apache.org/licenses/LICENSE-2.0 for details") == ["apache"]
    assert labels("Creative Commons Attribution-ShareAlike") == ["cc-by-sa"]
    assert labels("a permit and an elicense") == [] and labels("") == []
    assert len(licenses.rules()) >= 200


def test_license_prefilter_drops_nothing(texts):
    for t in list(texts.values())[:60]:
        low = (t or "").lower()
        able = {k for _, ks in licenses.prefilter().iter(low) for k in ks}
        assert all(k in able for k, (_, rx, _, _) in enumerate(licenses.rules()) if rx.search(low))


def test_license_suppression_on_long_and_crossing_texts():
    import time

    began = time.process_time()
    text = "MIT License. GNU Lesser General Public License v2.1 or later. " * 20_000
    assert [x[2] for x in licenses.detect(text)] == ["mit", "lgpl"] * 20_000
    assert time.process_time() - began < 30
    rng = random.Random(2)
    for _ in range(200):
        spans = [(a, a + rng.randrange(1, 12)) for a in (rng.randrange(20) for _ in range(15))]
        taken, kept = licenses.Taken(sorted({a for a, _ in spans})), []
        for a, b in spans:
            inside = any(x <= a and b <= y for x, y in kept)
            assert taken.holds(a, b) == inside
            if not inside:
                taken.add(a, b)
                kept.append((a, b))


def test_license_edges(edges, none):
    rows = licenses.scan(edges).collect()
    assert len(rows) == 12 and [r.labels for r in rows if r.doc_id == 8] == ["mit"] and [r.n_words for r in rows if r.doc_id == 0] == [0]
    assert licenses.scan(none).count() == 0


# 5 sentencepiece


def test_pieces_equal_the_library():
    enc = pieces.encoder(None)
    random.seed(5)
    alphabet = "ab the in ▁  \n\té日本😀\u0000x1.,'"
    vocabulary = list(enc.piece.values())
    for k in range(1500):
        t = "".join(random.choice(alphabet) for _ in range(random.randrange(40))) if k % 2 else "".join(random.choice(vocabulary) for _ in range(random.randrange(12))).replace("▁", " ")
        assert enc.encode(t) == [1, *enc.library.encode(t), 2]
    for t in ("a" * 5000, " " * 3000, "ab" * 3000):
        assert enc.encode(t) == [1, *enc.library.encode(t), 2]


def test_piece_digests(spark, texts, sf):
    lib = pieces.encoder(None).library
    for r in pieces.op5_pieces(spark, sf).collect():
        ids = [1, *lib.encode(texts[r.doc_id] or ""), 2]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_piece_edges(edges, none):
    rows = pieces.digest_documents(edges, with_ids=True).collect()
    assert len(rows) == 12 and [r.n_tokens for r in rows if r.doc_id in (0, 1)] == [2, 2]
    assert pieces.encode_documents(none).count() == 0


# 6 exact dedup


def test_exact_dedup_matches_sql(spark, duck, sf):
    got = exact_dedup.op6_exact_dedup(spark, sf)
    want = duck.sql(exact_dedup.SQL)
    order = [want.columns.index(c) for c in got.columns]
    same((tuple(r) for r in got.collect()), (tuple(r[i] for i in order) for r in want.fetchall()))


@pytest.mark.parametrize("cells,hot", [(1 << 28, 200), (1 << 14, 2)])
def test_exact_dedup_edges(spark, edges, none, monkeypatch, cells, hot):
    """Also with a filter too small to tell rows apart, and with nearly every group hot."""
    monkeypatch.setattr(exact_dedup, "MAX_CELLS", cells)
    monkeypatch.setattr(exact_dedup, "HOT", hot)
    rows = exact_dedup.exact_dedup(edges).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text_sha256].append(r)
    assert len(rows) == 12 and all(sum(r.kept for r in g) == 1 and {r.group_size for r in g} == {len(g)} for g in groups.values())
    assert {r.keep_id for r in rows if r.doc_id in (4, 5)} == {4} and {r.keep_id for r in rows if r.doc_id in (6, 7)} == {6}
    assert exact_dedup.exact_dedup(none).count() == 0


def test_bloom_never_misses(spark):
    ids = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2500).cast("string").alias("text"))
    assert exact_dedup.exact_dedup(ids).filter("kept").count() == 2500


def test_sliced_filter_tells_repeats_apart(spark, monkeypatch):
    """A filter of many slices in the shared folder: only repeats, and hardly any other row, are suspected."""
    monkeypatch.setattr(exact_dedup, "MAX_CELLS", 1 << 14)
    slices, size = exact_dedup.slices_for(6000)
    assert slices >= 8 and size == 1 << 14
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 200, F.col("id") % 70).otherwise(F.col("id")).cast("string").alias("text"))
    rows = exact_dedup.digests(docs).withColumn("part", F.pmod(F.xxhash64("sha"), F.lit(slices)).cast("int"))
    maybe = exact_dedup.suspected(rows, exact_dedup.write_filter(rows, slices, size), size).filter("maybe")
    assert 200 <= maybe.count() < 300
    got = exact_dedup.exact_dedup(docs).collect()
    assert {r.doc_id: r.keep_id for r in got} == {k: k % 70 if k < 200 else k for k in range(6000)}


# 7 sharding


def test_sharding_matches_sql_and_is_even(spark, duck, sf):
    got = sharding.op7_sharding(spark, sf)
    want = duck.sql(sharding.SQL)
    order = [want.columns.index(c) for c in got.columns]
    same((tuple(r) for r in got.collect()), (tuple(r[i] for i in order) for r in want.fetchall()))
    sizes = np.bincount(sharding.fill([f"shard-{i}" for i in range(32)], 4093))
    assert sizes.max() - sizes.min() <= 1


def test_sharding_moves_few_keys():
    names = [f"shard-{i}" for i in range(32)]
    a, b = sharding.fill(names, 4093), sharding.fill(names[:-1], 4093)
    moved = sum(x != y for x, y in zip(a, b) if x != 31)
    assert moved < 0.15 * 4093
    with pytest.raises(ValueError):
        sharding.fill(names, 4096)


def test_sharding_edges(edges, none):
    rows = sharding.shard(edges).collect()
    assert len(rows) == 12 and len({r.shard for r in rows if r.doc_id == 4}) == 1 and "slot" in rows[0]
    assert sharding.shard(none).count() == 0
    clash = edges.select(F.col("doc_id"), F.col("text").alias("_slot"), F.col("lang").alias("_shard"), F.col("row").alias("Slot_0"), F.col("fp").alias("shard"))
    got = sharding.shard(clash)
    assert got.columns == ["doc_id", "_slot", "_shard", "Slot_0", "slot", "shard"] and sorted(r.shard for r in got.collect()) == sorted(r.shard for r in rows)


# 8 decontamination


def test_planted_items_are_found_and_clean_ones_left(spark, texts, sf):
    items = {r.item_id: r.text for r in table(spark, sf, "benchmark").collect()}
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    index, size = defaultdict(list), {}
    for i, t in items.items():
        w = words(t)
        size[i] = len(w)
        for k in range(len(w) - 4):
            index[tuple(w[k : k + 5])].append((i, k))
    want = set()
    for d, t in texts.items():
        w, covered = words(t), defaultdict(set)
        for k in range(len(w) - 4):
            for i, p in index.get(tuple(w[k : k + 5]), ()):
                covered[i].update(range(p, p + 5))
        want |= {(d, i) for i, s in covered.items() if len(s) >= 0.8 * size[i]}
    got = {(r.doc_id, r.item_id) for r in decontam.op8_decontamination(spark, sf).collect()}
    assert got == want and got


@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_templates_and_slots(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "MAX_WINDOWS", limit)
    item = "If Alice has 3 apples and buys 5 kg more, how many apples does Alice have after 3 days?"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny item here")], "item_id long, text string")
    rows = [
        (1, "Well. " + item),
        (2, "If Bob has 7 apples and buys 9 pounds more, how many apples does Bob have after 7 days?"),
        (3, "If Bob has 7 apples and buys 9 pounds more, how many apples does Carol have after 8 days?"),
        (4, "Nothing of that kind stands here, only some words about apples and days."),
        (5, None),
        (6, "some tiny item here again"),
    ]
    out = {(r.doc_id, r.item_id): r.changed_slots for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert out[1, 1] == 0 and out[2, 1] > 0 and set(out) == {(1, 1), (2, 1), (6, 4)}


def _pairs_found(items, texts_):
    block = decontam.Block(list(enumerate(items)))
    out = set()
    for d, text in enumerate(texts_):
        words, breaks = decontam.split(text)
        out |= {(d, m[0]) for m in block.matches(words, decontam.Canonical().tokens(words, breaks))}
    return out


def test_insertions_deletions_and_longer_names_are_found():
    alice = "If Alice has 3 apples and buys 5 kg more, how many apples does Alice have after 3 days?"
    prose = "the quiet river turns below an old stone mill where children used to catch small silver fish before winter came"
    got = _pairs_found(
        [alice, prose],
        [
            alice.replace("Alice", "Mary Ann"),
            "We read that " + prose.replace("mill where", "mill right where") + " and so on",
            "We read that " + prose.replace("mill where", "where") + " and so on",
            "If Mary Ann has two hundred apples and buys 9 pounds more, how many apples does Mary Ann have after two hundred days?",
            "If Mary Ann has 3 apples and buys 5 kg more, how many apples does Carol have after 8 days?",
            "the quiet river turns below some hill and fish before winter came",
        ],
    )
    assert got == {(0, 0), (1, 1), (2, 1), (3, 0)}
    assert _pairs_found(["each ticket costs $5 so what do ten of them cost"], ["each ticket costs 7 dollars so what do ten of them cost"]) == {(0, 0)}


def test_verbatim_copies_of_slot_heavy_items_are_found():
    items = ["Solve 3 x + 5 = 20 for x", "Barack Obama and Michelle Obama met John Kerry in Paris", "WHAT IS THE CAPITAL CITY OF FRANCE NOW", "12 7 4 99 3 8"]
    assert _pairs_found(items, [f"so we said {x} and left" for x in items]) == {(k, k) for k in range(4)}
    again = "Barack Obama was elected president and Obama served two terms"
    assert _pairs_found([again], ["they said " + again + " in all"]) == {(0, 0)}
    assert _pairs_found(items, ["so we said 13 7 5 99 4 8 and left", "Anna Meyer and Otto Meyer met Karl Weber in Berlin"]) == set()


def test_decontamination_edges(spark, edges, none, sf):
    bench = table(spark, sf, "benchmark")
    assert decontam.contaminated(edges, bench).count() == 0 and decontam.contaminated(none, bench).count() == 0
    assert decontam.contaminated(edges, bench.limit(0)).count() == 0
    assert decontam.clean_documents(edges, bench).count() == 12


# 9 toxicity


def test_toxicity_finds_planted_words(spark, sf):
    import os

    from tests.conftest import SF

    larger = os.path.dirname(SF) + "/sf0.01"
    rows = {r.doc_id: r for r in toxicity.op9_toxicity(spark, larger).collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, larger, "labels").collect()}
    held = [k for k in labels if rows[k].held_out]
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for k, r in rows.items())
    assert np.mean([rows[k].predicted == labels[k] for k in held]) >= 0.9


def test_toxicity_recall_on_held_out_rows(spark):
    """The larger table: the smaller ones hold out a handful of toxic rows."""
    import os

    from tests.conftest import SF

    larger = os.path.dirname(SF) + "/sf0.1"
    rows = {r.doc_id: r for r in toxicity.op9_toxicity(spark, larger).collect()}
    held = [r for r in table(spark, larger, "labels").collect() if rows[r.doc_id].held_out]
    assert np.mean([rows[r.doc_id].predicted for r in held if r.toxic]) >= 0.8
    assert np.mean([1 - rows[r.doc_id].predicted for r in held if not r.toxic]) >= 0.99


def test_toxicity_counts_ratios_and_scores_match_brute_force(spark, sf):
    """The whole query but the fit's weights, which test_logistic_fit_is_a_minimum holds."""
    docs, labels = table(spark, sf, "documents"), {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    held_out = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    texts_ = {r.doc_id: r.text or "" for r in docs.collect()}
    own = {}
    for k, t in texts_.items():
        own[k] = {p[i : i + n] for w in re.findall(r"\w+", t.lower()) for p in [f" {w} "] for n in toxicity.GRAMS for i in range(len(p) - n + 1)}
    learn = [k for k in texts_ if k in labels and not held_out(k)]
    counts = Counter(), Counter()
    for k in learn:
        counts[labels[k] > 0].update(own[k])
    n1, n0 = sum(labels[k] > 0 for k in learn), sum(labels[k] == 0 for k in learn)
    rows = toxicity.labelled(docs.filter(toxicity.crc_mod("doc_id", 5) != 0), table(spark, sf, "labels"))
    table_ = toxicity.gram_counts(rows)
    got = {r.gram % (1 << 64): (r.toxic, r.other) for r in table_.collect()}
    assert got == {toxicity.gram_key(g): (counts[1][g], counts[0][g]) for g in counts[0] | counts[1]}
    want = {}
    for g in counts[0] | counts[1]:
        a, b = counts[1][g], counts[0][g]
        if (a * n0 - b * n1) ** 2 * (n1 + n0) / ((a + b) * max(n1 + n0 - a - b, 1) * n1 * n0) >= toxicity.SIGNIFICANT:
            want[toxicity.gram_key(g)] = np.log((a + 1) / (n1 + 2)) - np.log((b + 1) / (n0 + 2))
    found = {r.gram % (1 << 64): r.r for r in toxicity.features_of(table_, n1, n0).collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)
    model = toxicity.train(docs.filter(toxicity.crc_mod("doc_id", 5) != 0), table(spark, sf, "labels"))
    keys, weights, _ = model.load()
    weight = dict(zip(keys.tolist(), weights.tolist()))
    assert weight.keys() == want.keys()
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for k, mine in own.items():
        z = model.bias + sum(weight.get(toxicity.gram_key(g), 0.0) for g in mine)
        assert scores[k] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-9, abs=1e-12)


def test_toxicity_edges(spark, edges, none):
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 1), (8, 1, 0), (8, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(edges, labels)
    out = toxicity.score(edges, model).collect()
    assert len(out) == 12 and len({r.score for r in out if r.doc_id in (0, 1)}) == 1
    bare = toxicity.train(edges, labels.limit(0))
    assert all(r.score < 1e-6 for r in toxicity.score(edges, bare).collect())
    assert toxicity.score(none, model).count() == 0


def test_logistic_fit_is_a_minimum(monkeypatch):
    rng = np.random.default_rng(1)
    x = [sorted(rng.choice(30, 6, replace=False).tolist()) for _ in range(300)]
    r = rng.normal(size=30)
    y = np.array([(sum(r[i] for i in row) + rng.normal()) > 0 for row in x], float)
    monkeypatch.setattr(toxicity, "BLOCK", 100)
    w, b = toxicity.fit([np.array(row, "<u2").tobytes() for row in x], y, r)

    def loss(w, b):
        z = np.array([sum(w[i] * r[i] for i in row) + b for row in x])
        return np.logaddexp(0, z).sum() - (y * z).sum() + toxicity.PENALTY * (w @ w) / 2

    best = loss(w, b)
    assert all(loss(w + rng.normal(0, 0.05, 30), b + rng.normal(0, 0.05)) >= best - 1e-3 for _ in range(20))


# 10 url filter


def test_url_hosts_rules_and_terms():
    hp = url_filter.host_and_path
    assert hp("HTTP://WWW.Example.COM/en/1?x#y") == ("www.example.com", "/en/1") and hp("x") == hp(None) == ("", "") and hp("a://b#c") == ("b", "")
    rule = lambda u: url_filter.rule_for(*hp(u), url_filter.RULES)
    assert rule("http://a.example.com/en/1") == ("example.com/en/", "block")
    assert rule("http://a.www.example.com/en/1") == ("www.example.com/en/", "allow")
    assert rule("http://a.com/x") == ("com/", "allow") and rule("http://a.com") is None and rule("http://xcom/a") is None
    assert rule("http://a.net/es/") == ("net/es/", "block")
    assert url_filter.hits("http://free-porn.org/") == ({"porn"}, {"free"})
    assert url_filter.hits("http://sussex.org/scunthorpe") == (set(), set())


def test_url_query_matches_sql(spark, duck, sf):
    got = url_filter.op10_url_filter(spark, sf)
    want = duck.sql(url_filter.ORACLE["op10_url_filter"])
    order = [want.columns.index(c) for c in got.columns]
    same((tuple(r) for r in got.collect()), (tuple(r[i] for i in order) for r in want.fetchall()))


def test_url_query_and_edges(spark, sf):
    rows = url_filter.op10_url_filter(spark, sf).collect()
    assert len(rows) == table(spark, sf, "pages").count()
    assert all(r.verdict == ("block" if r.rule in ("example.com/en/", "net/es/", "net/fr/") else "allow") for r in rows if r.rule)
    odd = spark.createDataFrame([(1, None, "h"), (2, "", "h"), (3, "http://a.org/sex/casino", "h"), (3, "http://a.org/sex/casino", "h"), (4, "http://a.org/sex/sex", "h"), (None, "http://spam.org", "h")], "page_id long, url string, host string")
    assert [r.verdict for r in url_filter.judge(odd).orderBy(F.col("page_id").asc_nulls_last()).collect()] == ["allow", "allow", "block", "block", "allow", "block"]
    assert url_filter.judge(odd.limit(0)).count() == 0


# 8 decontamination, generated


TEMPLATES = (
    "{a} has {n} apples and gives {m} of them to {b}. How many apples does {a} have left?",
    "A train leaves {c} at {n} km/h and needs {m} hours to reach {d}. How far is it from {c} to {d}?",
    "If {a} walks {n} miles on each of {m} days, how many miles does {a} walk in all?",
    "{b} bought {n} pounds of rice for {m} dollars, and {a} paid half as much. What did {a} pay for the rice?",
    "In {c} a tank holds {n} liters of water and loses {m} liters every hour until it is empty. After how many hours is that?",
)


def _filled(template, rng):
    names = ["Alice", "Bob", "Carol", "Mary Ann", "Jean Paul", "Dmitri", "Olga", "Otto von Berg"]
    a, b, c, d = rng.sample(names, 2) + rng.sample(["Paris", "New York", "Rome", "Los Angeles", "Kyiv"], 2)
    n, m = rng.sample(["3", "17", "twenty five", "250", "1,200", "forty", "two hundred"], 2)
    return template.format(a=a, b=b, c=c, d=d, n=n, m=m)


def test_recall_on_reparameterised_and_verbatim_items():
    rng = random.Random(11)
    prose = "the old mill beside a quiet river had not turned for many winters and nobody in that village knew why".split()
    around = lambda x: " ".join(rng.choices(prose, k=40)) + ". " + x + " " + " ".join(rng.choices(prose, k=40)).capitalize() + "."
    items = [_filled(t, rng) for t in TEMPLATES]
    again = [(k % len(items), around(_filled(TEMPLATES[k % len(items)], rng))) for k in range(200)]
    got = _pairs_found(items, [t for _, t in again])
    assert np.mean([(d, k) in got for d, (k, _) in enumerate(again)]) >= 0.9 and all(k == again[d][0] for d, k in got)
    assert _pairs_found(items, [around(x) for x in items]) == {(k, k) for k in range(len(items))}
    assert _pairs_found(items, [around("") for _ in range(50)]) == set()
    # Different values for what the item says twice aren't the item.
    assert _pairs_found(items[2:3], [around("If Bob walks 4 miles on each of 9 days, how many miles does Olga walk in all?")]) == set()


def test_many_items_of_one_template_and_a_long_text():
    """What an item shares with others doesn't call it up, and all whose own words stand there are found."""
    items = [f"Which colour has the {w}{k} in the yard behind the house of the mayor?" for k, w in enumerate(["rose", "gate", "barn"] * 200)]
    block = decontam.Block(list(enumerate(items)))
    words, breaks = decontam.split(" ".join(items[:40] * 20))
    assert {m[0] for m in block.matches(words, decontam.Canonical(block.known).tokens(words, breaks))} >= set(range(40))
    assert all(block.likely(x) for x in items)


def test_bulk_cache_keeps_two_generations_and_no_long_parts():
    import public_tokenizers

    from tidewater.llm.common import WordCache

    enc = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    enc.cache = WordCache(40_000)
    texts = [f"word{i % 150} other{i} {'x' * 60}{i % 3}" for i in range(400)] + ["", " ", "a<|endoftext|>b", "c\x1cd"]
    for k in range(0, len(texts), 40):
        some = texts[k : k + 40]
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_bytes(some)] == [e.ids for e in enc.tokenizer.encode_batch(some, add_special_tokens=False)]
        assert enc.cache.used <= 20_000 and all(len(x) <= token_files.CACHE_LENGTH for x in [*enc.cache, *enc.cache.old])
    assert enc.cache.old
