"""License scan with ordered signature rules.

Rules are regular expressions in order of priority: whole notices, then SPDX tags, links, phrases that license the text,
then names. Each has keywords; one Aho-Corasick pass over the text tells which rules can match at all, and only their
expressions run. Detections are taken by priority, longer ones first, and one that lies inside a taken detection is
suppressed, so that "GNU Lesser General Public License" isn't also reported by a rule for a shorter name within it.

The base is separate and exact: every place where a phrase's words stand consecutively.

Defined cases: a null text counts as empty and has no detection, score 0; repeated rows get equal results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.common import slices, table, texts_of

# Label, SPDX identifiers, names as expressions, link stems, keywords of which any name holds one.
LICENSES = (
    ("agpl", "AGPL-3.0 AGPL-1.0", r"(?:gnu )?affero general public licen[sc]e", "gnu.org/licenses/agpl", "affero"),
    ("lgpl", "LGPL-2.0 LGPL-2.1 LGPL-3.0", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", "gnu.org/licenses/lgpl", "lesser|library"),
    ("gfdl", "GFDL-1.1 GFDL-1.2 GFDL-1.3", r"gnu free documentation licen[sc]e", "gnu.org/licenses/fdl", "documentation"),
    ("gpl", "GPL-1.0 GPL-2.0 GPL-3.0", r"(?:gnu )?general public licen[sc]e", "gnu.org/licenses/gpl", "general"),
    ("apache", "Apache-1.0 Apache-1.1 Apache-2.0", r"apache (?:software )?licen[sc]e", "apache.org/licenses/license-2.0", "apache"),
    ("mit", "MIT MIT-0", r"(?:mit|expat|x11) licen[sc]e", "opensource.org/licenses/mit", "mit|expat|x11"),
    ("bsd", "BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause 0BSD", r"(?:(?:new|modified|simplified|revised|[1-4]-clause) )?bsd(?: [1-4]-clause)? licen[sc]e", "opensource.org/licenses/bsd", "bsd"),
    ("isc", "ISC", r"isc licen[sc]e", "opensource.org/licenses/isc", "isc"),
    ("mpl", "MPL-1.0 MPL-1.1 MPL-2.0", r"mozilla public licen[sc]e", "mozilla.org/mpl", "mozilla"),
    ("epl", "EPL-1.0 EPL-2.0", r"eclipse public licen[sc]e", "eclipse.org/legal/epl", "eclipse"),
    ("cddl", "CDDL-1.0 CDDL-1.1", r"common development and distribution licen[sc]e", "opensource.org/licenses/cddl", "development"),
    ("cpl", "CPL-1.0", r"common public licen[sc]e", "opensource.org/licenses/cpl", "common"),
    ("cc0", "CC0-1.0", r"(?:cc0|creative commons zero)(?: licen[sc]e)?", "creativecommons.org/publicdomain/zero", "cc0|commons"),
    ("cc-by-nc-nd", "CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0", r"creative commons attribution[ -]noncommercial[ -]noderiv(?:ative)?s?(?: licen[sc]e)?", "creativecommons.org/licenses/by-nc-nd", "commons"),
    ("cc-by-nc-sa", "CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0", r"creative commons attribution[ -]noncommercial[ -]sharealike(?: licen[sc]e)?", "creativecommons.org/licenses/by-nc-sa", "commons"),
    ("cc-by-nc", "CC-BY-NC-3.0 CC-BY-NC-4.0", r"creative commons attribution[ -]noncommercial(?: licen[sc]e)?", "creativecommons.org/licenses/by-nc/", "commons"),
    ("cc-by-sa", "CC-BY-SA-3.0 CC-BY-SA-4.0", r"creative commons attribution[ -]share-?alike(?: licen[sc]e)?", "creativecommons.org/licenses/by-sa", "commons"),
    ("cc-by-nd", "CC-BY-ND-3.0 CC-BY-ND-4.0", r"creative commons attribution[ -]noderiv(?:ative)?s?(?: licen[sc]e)?", "creativecommons.org/licenses/by-nd", "commons"),
    ("cc-by", "CC-BY-3.0 CC-BY-4.0", r"creative commons attribution(?: licen[sc]e)?", "creativecommons.org/licenses/by/", "commons"),
    ("artistic", "Artistic-1.0 Artistic-2.0", r"artistic licen[sc]e", "opensource.org/licenses/artistic", "artistic"),
    ("bsl", "BSL-1.0", r"boost software licen[sc]e", "boost.org/license", "boost"),
    ("zlib", "Zlib", r"zlib licen[sc]e", "zlib.net/zlib_license", "zlib"),
    ("unlicense", "Unlicense", r"the unlicense", "unlicense.org", "unlicense"),
    ("wtfpl", "WTFPL", r"do what the f\w+ you want to public licen[sc]e", "wtfpl.net", "want"),
    ("eupl", "EUPL-1.1 EUPL-1.2", r"european union public licen[sc]e", "eupl.eu", "european"),
    ("ofl", "OFL-1.0 OFL-1.1", r"(?:sil )?open font licen[sc]e", "scripts.sil.org/ofl", "font"),
    ("python", "PSF-2.0 Python-2.0", r"python software foundation licen[sc]e", "python.org/psf/license", "python"),
    ("php", "PHP-3.0 PHP-3.01", r"php licen[sc]e", "php.net/license", "php"),
    ("ruby", "Ruby", r"ruby licen[sc]e", "ruby-lang.org/en/about/license", "ruby"),
    ("openssl", "OpenSSL", r"openssl licen[sc]e", "openssl.org/source/license", "openssl"),
    ("postgresql", "PostgreSQL", r"postgresql licen[sc]e", "postgresql.org/about/licence", "postgresql"),
    ("ms-pl", "MS-PL", r"microsoft public licen[sc]e", "opensource.org/licenses/ms-pl", "microsoft"),
    ("ms-rl", "MS-RL", r"microsoft reciprocal licen[sc]e", "opensource.org/licenses/ms-rl", "microsoft"),
    ("odbl", "ODbL-1.0", r"open database licen[sc]e", "opendatacommons.org/licenses/odbl", "database"),
    ("busl", "BUSL-1.1", r"business source licen[sc]e", "mariadb.com/bsl", "business"),
    ("sspl", "SSPL-1.0", r"server side public licen[sc]e", "mongodb.com/licensing/server-side-public-license", "server"),
    ("elastic", "Elastic-2.0", r"elastic licen[sc]e", "elastic.co/licensing/elastic-license", "elastic"),
)
# Label, a passage of the license's own notice, keyword.
NOTICES = (
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy", "hereby"),
    ("isc", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee", "permission"),
    ("bsd", r"redistribution and use in source and binary forms, with or without modification", "redistribution"),
    ("gpl", r"this program is free software[:;] you can redistribute it and/or modify", "redistribute"),
    ("mpl", r"this source code form is subject to the terms of the mozilla public licen[sc]e", "mozilla"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("zlib", r"this software is provided 'as-is', without any express or implied warranty", "as-is"),
    ("proprietary", r"all rights reserved", "reserved"),
    ("proprietary", r"(?:proprietary and confidential|unauthori[sz]ed copying of this file)", "propriet|unauthori"),
    ("public-domain", r"(?:released|placed|dedicated) (?:in)?to the public domain", "domain"),
)
# How a text says that it is under a license; each with every name makes a rule.
GRANTS = (r"(?:is |are )?(?:licen[sc]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?", r"subject to (?:the )?(?:terms of )?(?:the )?", r"licen[sc]e: ?(?:the )?")
VERSION = r"(?:,? ?v(?:ersion)? ?\.?\d+(?:\.\d+)*)?(?: or (?:any )?later)?"
#: Base phrases, as words, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@lru_cache(maxsize=1)
def rules() -> tuple[tuple[str, re.Pattern, tuple[str, ...], float], ...]:
    """(label, expression, keywords of which one must stand in the text, score), in order of priority."""
    out: list[tuple[str, re.Pattern, tuple[str, ...], float]] = []

    def add(label: str, expression: str, keys, score: float) -> None:
        out.append((label, re.compile(expression), tuple(keys), score))

    for label, passage, keys in NOTICES:
        add(label, passage.replace(" ", r"\s+"), keys.split("|"), 1.0)
    for label, spdx, *_ in LICENSES:
        for tag in spdx.lower().split():
            add(label, rf"spdx-licen[sc]e-identifier:\s*\(?{re.escape(tag)}(?:-only|-or-later|\+)?(?![\w.-])", ["spdx-li"], 1.0)
    for label, _, _, link, _ in LICENSES:
        add(label, rf"(?:https?://)?(?:www\.)?{re.escape(link)}[\w./-]*", [link], 0.95)
    for grant in GRANTS:
        for label, _, name, _, keys in LICENSES:
            add(label, rf"\b{grant}{name}\b{VERSION}".replace(" ", r"\s+").replace(r"\s+?", r"\s*"), keys.split("|"), 0.9)
    for label, _, name, _, keys in LICENSES:
        add(label, rf"\b{name}\b{VERSION}".replace(" ", r"\s+").replace(r"\s+?", r"\s*"), keys.split("|"), 0.7)
    return tuple(out)


@lru_cache(maxsize=1)
def prefilter():
    """Automaton of all rules' keywords; a value is the numbers of the rules that it lets run."""
    import ahocorasick

    by: dict[str, list[int]] = {}
    for k, (_, _, keys, _) in enumerate(rules()):
        for x in keys:
            by.setdefault(x, []).append(k)
    out = ahocorasick.Automaton()
    for x, ks in by.items():
        out.add_word(x, tuple(ks))
    out.make_automaton()
    return out


class Taken:
    """Intervals taken so far. By place, the largest end of those that begin at it or before (a binary indexed tree), so that
    asking whether one contains another takes a logarithm of their number."""

    def __init__(self, starts: list[int]):
        self.starts = starts
        self.ends = [0] * (len(starts) + 1)

    def holds(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start)
        while k:
            if self.ends[k] >= end:
                return True
            k -= k & -k
        return False

    def add(self, start: int, end: int) -> None:
        k = bisect_right(self.starts, start)
        while k < len(self.ends):
            self.ends[k] = max(self.ends[k], end)
            k += k & -k


def detect(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, label, score) of the detections that stay, by place."""
    low = text.lower()
    if len(low) != len(text):  # lower-casing changed places; only A-Z then
        low = text.translate({c: c + 32 for c in range(65, 91)})
    able = sorted({k for _, ks in prefilter().iter(low) for k in ks})
    found = sorted((k, m.start() - m.end(), m.start(), m.end()) for k in able for m in rules()[k][1].finditer(low))
    taken, out = Taken(sorted({x[2] for x in found})), []
    for k, _, a, b in found:
        if not taken.holds(a, b):
            taken.add(a, b)
            out.append((a, b, rules()[k][0], rules()[k][3]))
    return sorted(out)


def base(text: str, phrases=PHRASES) -> tuple[int, list[tuple[int, str]]]:
    """(number of words, (place, label) of every place where a phrase's words stand consecutively)."""
    words = text.encode().translate(_TO_WORDS).split()
    out = []
    for phrase, label in phrases:
        wanted = phrase.encode().split()
        at, n = -1, len(wanted)
        while True:
            try:
                at = words.index(wanted[0], at + 1)
            except ValueError:
                break
            if words[at : at + n] == wanted:
                out.append((at, label))
    return len(words), out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans): spans holds the detections that stay."""
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("score", pa.float64())])
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(span)]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches):
        for part in slices(batches):
            rows = []
            for text in texts_of(part):
                n, places = base(text)
                spans = detect(text)
                own, starts = {x for _, x in places}, [k for k, _ in places]
                every = sorted(own | {x[2] for x in spans})
                score = max([0.0, *(x[3] for x in spans), *([0.8] if own else [])])
                rows.append((n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(every), score, [dict(zip(("start", "end", "label", "score"), x)) for x in spans]))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=[id_col, *names])

    schema = f"{id_col} {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start: long, end: long, label: string, score: double>>"
    return docs.select(docs[id_col], docs[text_col].alias("text")).mapInArrow(run, schema)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op4_licenses": op4_licenses}
ORACLE: dict[str, str] = {}
