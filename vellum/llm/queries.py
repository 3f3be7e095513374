"""Queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from vellum.llm import decontaminate, packing, pii, prefixhash, quality, sharding, simhash, suffixtree, tokenfile, urls


def queries() -> dict:
    return {
        "op1_pii": pii.op1_pii,
        "op2_prefix_hashes": prefixhash.op2_prefix_hashes,
        "op3_ftrl_quality": quality.op3_ftrl_quality,
        "op4_seed_align": decontaminate.op4_seed_align,
        "op5_simhash_trie": simhash.op5_simhash_trie,
        "op6_token_file": tokenfile.op6_token_file,
        "op7_best_fit": packing.op7_best_fit,
        "op8_template_tree": urls.op8_template_tree,
        "op9_suffix_tree": suffixtree.op9_suffix_tree,
        "op10_virtual_slots": sharding.op10_virtual_slots,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_template_tree": urls.ORACLE_SQL}
