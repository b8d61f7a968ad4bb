"""Queries and SQL of the operators in this package."""

from __future__ import annotations

from . import op1_language_mixture, op2_mixture, op3_quality_fm, op4_compaction, op5_warc, op6_bloom_lm, op7_pack, op8_decontaminate, op9_adaptive_scan, op10_minhash, op11_fill_middle, op12_prefix_trie, op13_substring_dedup

MODULES = (op1_language_mixture, op2_mixture, op3_quality_fm, op4_compaction, op5_warc, op6_bloom_lm, op7_pack, op8_decontaminate, op9_adaptive_scan, op10_minhash, op11_fill_middle, op12_prefix_trie, op13_substring_dedup)
QUERIES = {m.NAME: m.query for m in MODULES}
ORACLES = {m.NAME: m.ORACLE_SQL for m in MODULES if m.ORACLE_SQL}
