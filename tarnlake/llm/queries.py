"""The queries of this package and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from tarnlake.llm import bpe, exact_dedup, fingerprints, licenses, line_dedup, near_dedup, packing, pii, prefix_trie, quality, spelling, substring_dedup, toxicity


def queries() -> dict:
    return {
        "op1_pii": pii.op1_pii,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_licenses": licenses.op3_licenses,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_fingerprints": fingerprints.op5_fingerprints,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_substring_dedup": substring_dedup.op8_substring_dedup,
        "op9_bpe": bpe.op9_bpe,
        "op10_packing": packing.op10_packing,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_quality": quality.op12_quality,
        "op13_spelling": spelling.op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": exact_dedup.ORACLE, "op6_line_dedup": line_dedup.ORACLE, "op8_substring_dedup": substring_dedup.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE, "op13_spelling": spelling.ORACLE}
