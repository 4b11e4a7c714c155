"""The pipeline's stages, each held against a brute-force version on its own input."""

import re

import corpus_pipeline
from tests.llm.test_llm import brute_components
from tidewater.llm import decontam, pieces, simhash
from tidewater.llm.common import fresh_path, table


def test_stages_do_their_work(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_path(spark, "s")
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs)
    first, exact, near, clean, last = kept
    for df in kept[:-1]:
        assert df.columns == columns
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    a, b, c, d = map(text, kept[:-1])
    assert len(a) > 0.97 * table(spark, sf, "documents").count()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    lowest = {}
    for k in sorted(a):
        lowest.setdefault(norm(a[k]), k)
    assert set(b) == set(lowest.values())
    low = brute_components({k: simhash.fingerprint(t) for k, t in b.items()})
    assert set(c) == {k for k, v in low.items() if k == v}
    gone = {r.doc_id for r in decontam.contaminated(near, table(spark, sf, "benchmark")).collect()}
    assert set(d) == set(c) - gone and gone
    lib = pieces.encoder(None).library
    assert {r.doc_id: r.n_tokens for r in last.collect()} == {k: len(lib.encode(t or "")) + 2 for k, t in d.items()}


def test_stages_decide_by_row(spark, sf):
    """Repeated and null ids: each row stays or goes by its own text."""
    docs = table(spark, sf, "documents").filter("lang is not null and n_chars between 200 and 2000").limit(30).select("doc_id", "text", "lang")
    a, b, c, d = [r.text for r in docs.orderBy("doc_id").limit(4).collect()]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rows = lambda df: sorted([(r.doc_id, r.text) for r in df.collect()], key=str)
    twice = frame([(1, a, "x"), (1, a, "x"), (2, b, "x"), (3, a, "x"), (3, c, "x"), (None, d, "x"), (None, d, "x"), (None, a, "x")])
    want = sorted([(1, a), (2, b), (3, c), (None, d)], key=str)
    assert rows(corpus_pipeline.exact_copies(spark, twice, sf)) == want
    assert rows(corpus_pipeline.near_copies(spark, twice, sf)) == want
    item = table(spark, sf, "benchmark").first().text
    leaks = frame([(1, a, "x"), (1, item, "x"), (None, b, "x"), (None, item, "x")])
    assert rows(corpus_pipeline.decontamination(spark, leaks, sf)) == sorted([(1, a), (None, b)], key=str)
    odd = docs.unionByName(frame([(None, a, None), (None, "", None), (9999, b, None), (9999, "", None)]))
    got = rows(corpus_pipeline.language_id(spark, odd, sf))
    assert [x for x in got if x[0] in (None, 9999)] == sorted([(None, a), (9999, b)], key=str)


def test_run_gives_the_last_stage(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
