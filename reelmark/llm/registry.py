"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from reelmark.llm import chat, decontamination, exact_dedup, html_extraction, near_dedup, packing, periodic_runs, substring_dedup, suffix_dedup, toxicity, url_filters, warc, whitening

QUERIES = {
    "op4_suffix_array_dedup": suffix_dedup.op4_suffix_array_dedup,
    "op5_html_extraction": html_extraction.op5_html_extraction,
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op7_minhash_near_dedup": near_dedup.op7_minhash_near_dedup,
    "op3_benchmark_decontamination": decontamination.op3_benchmark_decontamination,
    "op2_url_filters": url_filters.op2_url_filters,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_warc": warc.op11_warc,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}
ORACLES = {
    "op2_url_filters": url_filters.OP2_SQL,
    "op8_chat_formatting": chat.OP8_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op11_warc": warc.OP11_SQL,
}
