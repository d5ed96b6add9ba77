"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, hamming, language, line_runs, mixing, ngram_join, pseudonyms, suffix_dedup, warc, wavelet

QUERIES = {
    "op1_language_id": language.op1_language_id,
    "op2_token_wavelet": wavelet.op2_token_wavelet,
    "op3_ngram_jaccard_join": ngram_join.op3_ngram_jaccard_join,
    "op4_warc": warc.op4_warc,
    "op5_hamming_topk": hamming.op5_hamming_topk,
    "op6_source_mix": mixing.op6_source_mix,
    "op7_pseudonyms": pseudonyms.op7_pseudonyms,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_line_runs": line_runs.op10_line_runs,
    "op10_line_runs_long_lines": line_runs.op10_line_runs_long_lines,
}

#: Operators 1, 2, 7 and 9 are not in SQL: their tests compare with brute force, round trips or held-out rows.
ORACLE_SQL = {
    "op3_ngram_jaccard_join": ngram_join.SQL,
    "op4_warc": warc.SQL,
    "op5_hamming_topk": hamming.SQL,
    "op6_source_mix": mixing.SQL,
    "op8_decontamination": decontaminate.SQL,
    "op10_line_runs": line_runs.SQL,
    "op10_line_runs_long_lines": line_runs.SQL_LONG,
}
