"""URL filter by a weighted vocabulary.

An Aho-Corasick automaton counts strict and soft terms in the lower-cased URL; a hit counts where both its ends are at a
boundary (the URL's start or end, or a character that is neither letter nor digit). One strict term or several distinct
soft terms block the URL. Host rules, where one fits, come before the vocabulary.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule, and its terms still count;
repeated rows are judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.common import table

#: Terms that alone block a URL, and terms of which SOFT_LIMIT distinct ones do.
STRICT = ("porn", "xxx", "hentai", "camgirls", "escorts", "malware", "phishing", "warez", "keygen", "spam", "cheap-pills", "viagra", "cialis", "darknet", "free-casino", "payday-loans")
SOFT = ("adult", "sex", "nude", "casino", "poker", "betting", "gambling", "pills", "pharmacy", "cheap", "loan", "loans", "credit", "win", "prize", "bonus", "crack", "torrent", "hack", "dating", "hot", "free", "deal", "farm")
SOFT_LIMIT = 2
#: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

_UPPER = {c: c + 32 for c in range(65, 91)}
_HOST = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")


def host_and_path(url: str | None) -> tuple[str, str]:
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    host = _HOST.match(url, at + 3).group()
    return host.translate(_UPPER), _PATH.match(url, at + 3 + len(host)).group()


def rule_for(host: str, path: str, rules) -> tuple[str, str] | None:
    """(rule as text, verdict) of the longest rule whose host is the URL's or a parent of it and whose path begins the URL's."""
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=None)


@lru_cache(maxsize=4)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (2, strict)):
        for x in terms:
            out.add_word(x, (x, weight))
    out.make_automaton()
    return out


def hits(url: str, strict=STRICT, soft=SOFT) -> tuple[set[str], set[str]]:
    """The distinct strict and soft terms at boundaries."""
    low, found = url.translate(_UPPER), (set(), set())
    for end, (term, weight) in automaton(strict, soft).iter(low):
        start = end - len(term) + 1
        if (start == 0 or not low[start - 1].isalnum()) and (end + 1 == len(low) or not low[end + 1].isalnum()):
            found[weight == 1].add(term)
    return found


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """(id, host, path, rule, verdict, strict_hits, soft_hits)."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                host, path = host_and_path(url)
                hard, mild = hits(url or "", strict, soft)
                rule, verdict = rule_for(host, path, rules) or (None, "block" if hard or len(mild) >= soft_limit else "allow")
                rows.append((key, host, path, rule, verdict, len(hard), len(mild)))
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (batch.schema.field(0).type, *[pa.string()] * 4, pa.int32(), pa.int32()))], names=[id_col, "host", "path", "rule", "verdict", "strict_hits", "soft_hits"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col).mapInArrow(run, f"{id_col} {kind}, host string, path string, rule string, verdict string, strict_hits int, soft_hits int")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _sql() -> str:
    fits = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    when = lambda out: " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{out(h, p, v)}'" for h, p, v in fits)
    count = lambda terms: " + ".join(rf"regexp_matches(low, '(^|[^\p{{L}}\p{{N}}]){x}($|[^\p{{L}}\p{{N}}])')::INTEGER" for x in terms)
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH u AS (SELECT page_id, {lower("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path, {lower("coalesce(url, '')")} AS low FROM pages),
c AS (SELECT page_id, host, path, {count(STRICT)} AS strict_hits, {count(SOFT)} AS soft_hits FROM u)
SELECT page_id, host, path, CASE {when(lambda h, p, v: h + p)} END AS rule, CASE {when(lambda h, p, v: v)} WHEN strict_hits > 0 OR soft_hits >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict, strict_hits, soft_hits FROM c"""


QUERIES = {"op10_url_filter": op10_url_filter}
ORACLE = {"op10_url_filter": _sql()}
