"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import byte_bpe, decontamination, hard_negatives, line_dedup, packing, periodic_runs, quality, secrets, simhash, suffix_dedup, token_counts, topk_search, warc

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_byte_bpe": byte_bpe.op4_byte_bpe,
    "op5_warc": warc.op5_warc,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_topk_search": topk_search.op7_topk_search,
    "op8_simhash": simhash.op8_simhash,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_decontamination": decontamination.op11_decontamination,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

SQL: dict[str, str] = {
    "op5_warc": warc.OP5_SQL,
    "op11_decontamination": decontamination.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_periodic_runs": periodic_runs.OP13_SQL,
}
