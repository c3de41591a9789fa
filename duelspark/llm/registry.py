"""The corpus queries and their SQL."""

from __future__ import annotations

from . import decontaminate, exact_dedup, html_extract, language_id, license_scan, near_dedup, periodic_runs, sentencepiece_fst, spelling_variants, suffix_dedup, token_counts, token_files, warc

_QUERIES = {
    "op1_exact_dedup": (exact_dedup.op1_exact_dedup, exact_dedup.ORACLE_SQL),
    "op2_license_scan": (license_scan.op2_license_scan, license_scan.ORACLE_SQL),
    "op3_minhash_near_dedup": (near_dedup.op3_minhash_near_dedup, None),
    "op4_warc": (warc.op4_warc, warc.ORACLE_SQL),
    "op5_benchmark_decontamination": (decontaminate.op5_benchmark_decontamination, decontaminate.ORACLE_SQL),
    "op6_token_counts": (token_counts.op6_token_counts, token_counts.ORACLE_SQL),
    "op7_language_id": (language_id.op7_language_id, None),
    "op8_html_extraction": (html_extract.op8_html_extraction, None),
    "op9_sentencepiece": (sentencepiece_fst.op9_sentencepiece, None),
    "op10_suffix_dedup": (suffix_dedup.op10_suffix_dedup, None),
    "op11_token_files": (token_files.op11_token_files, None),
    "op12_spelling_variants": (spelling_variants.op12_spelling_variants, spelling_variants.ORACLE_SQL),
    "op13_periodic_runs": (periodic_runs.op13_periodic_runs, None),
}


def queries() -> dict:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
