"""The queries of this package: name -> (function of (spark, sf_dir), oracle SQL or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = ("secret_scan", "token_histogram", "license_scan", "source_mix", "ngram_join", "warc_segments",
           "decontaminate", "chat_parts", "cap_filters", "language_id", "byte_bpe", "lexical_search", "prefix_trie")


def load() -> dict:
    out = {}
    for m in MODULES:
        mod = import_module(f"cellcast.llm.{m}")
        out[mod.QUERY] = (mod.run, mod.ORACLE_SQL)
    return out
