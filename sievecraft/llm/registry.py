"""The queries of this folder and their SQL."""

from __future__ import annotations

from sievecraft.llm import bpe, compact_windows, dart_minhash, decontaminate, embedding_dedup, host_rules, prefix_trie, pseudonyms, sharding, token_files, toxicity, warc, whitening

_MODULES = (warc, host_rules, pseudonyms, sharding, decontaminate, bpe, dart_minhash, toxicity, compact_windows, token_files, prefix_trie, whitening, embedding_dedup)

QUERIES = {name: q for module in _MODULES for name, q in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
