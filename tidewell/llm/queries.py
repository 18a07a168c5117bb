"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import band_join, decontaminate, exact_dedup, jaccard_join, lexical_search, license_scan, line_dedup, minhash_dedup, pii, quality_lm, sentencepiece_lattice, token_counts, toxicity

QUERIES = {f.__name__: f for f in (pii.op1_pii, exact_dedup.op2_exact_dedup, token_counts.op3_token_counts, quality_lm.op4_quality_classifier, sentencepiece_lattice.op5_sentencepiece, line_dedup.op6_line_dedup, license_scan.op7_license_scan, decontaminate.op8_decontamination, jaccard_join.op9_jaccard_join, toxicity.op10_toxicity, minhash_dedup.op11_minhash_dedup, band_join.op12_band_join, lexical_search.op13_lexical_search)}
ORACLE_SQL = {"op2_exact_dedup": exact_dedup.ORACLE_SQL, "op8_decontamination": decontaminate.ORACLE_SQL, "op12_band_join": band_join.ORACLE_SQL, "op13_lexical_search": lexical_search.ORACLE_SQL}
