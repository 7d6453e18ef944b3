"""The queries and oracle SQL of this package."""

from __future__ import annotations

from . import exact_dedup, fingerprint, html_extract, line_dedup, mixing, packing, quality, simhash_dedup, token_counts, token_files


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_token_counts": token_counts.op2_token_counts,
        "op3_html_extract": html_extract.op3_html_extract,
        "op4_fingerprints": fingerprint.op4_fingerprints,
        "op5_packing": packing.op5_packing,
        "op6_mixing": mixing.op6_mixing,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_simhash_dedup": simhash_dedup.op8_simhash_dedup,
        "op9_quality_classifier": quality.op9_quality_classifier,
        "op10_token_files": token_files.op10_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.ORACLE, "op7_line_dedup": line_dedup.ORACLE}
