"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tidewater.llm import decontam, exact_dedup, language, licenses, pieces, sharding, simhash, token_files, toxicity, url_filter

MODULES = (token_files, language, simhash, licenses, pieces, exact_dedup, sharding, decontam, toxicity, url_filter)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
