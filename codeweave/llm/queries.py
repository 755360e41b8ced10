"""Registration of the operators' queries; each module adds its own."""
from __future__ import annotations

from importlib import import_module

LLM_QUERIES: dict = {}
LLM_ORACLES: dict = {}

for _name in ("exact_dedup", "mixing", "simhash", "warc", "toxicity", "secrets", "html_extract", "decontaminate", "suffix_dedup", "tool_calls", "bpe", "ranked_search", "prefix_trie"):
    _m = import_module(f".{_name}", __package__)
    LLM_QUERIES.update(_m.QUERIES)
    LLM_ORACLES.update(_m.ORACLES)
