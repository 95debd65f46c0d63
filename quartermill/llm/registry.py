"""The numbered queries of this subpackage and those of their oracles that SQL can express."""

from __future__ import annotations

from . import bpe, divergence, langid, maintext, neardup, neighbours, packing, prefixes, quality, rules, sharding, substrings, warc


def queries() -> dict:
    found = (packing.op1_packing, quality.op2_quality, neardup.op3_minhash, sharding.op4_sharding, bpe.op5_bpe, neighbours.op6_neighbours, rules.op7_quality_rules, warc.op8_warc, substrings.op9_suffix_array, langid.op10_langid)
    return {f.__name__: f for f in (*found, divergence.op11_divergence, prefixes.op12_prefix_trie, maintext.op13_main_text)}


def oracle_sql() -> dict[str, str]:
    return {**rules.SQL, **divergence.SQL, **prefixes.SQL, **maintext.SQL}
