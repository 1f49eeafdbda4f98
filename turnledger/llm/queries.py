"""Registered queries of the corpus operators and their DuckDB statements."""

from __future__ import annotations

from turnledger.llm import (
    collocations,
    exact_dedup,
    language_id,
    lexical_search,
    license_scan,
    lm_scoring,
    mixing,
    ngram_jaccard,
    packing,
    quality,
    sharding,
    topk_search,
    toxicity,
)

LLM_QUERIES = {
    "op1_weighted_fair_mix": mixing.op1_weighted_fair_mix,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_ngram_jaccard": ngram_jaccard.op4_ngram_jaccard,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_lm_scoring": lm_scoring.op6_lm_scoring,
    "op7_topk_search": topk_search.op7_topk_search,
    "op8_virtual_slots": sharding.op8_virtual_slots,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_language_id": language_id.op10_language_id,
    "op11_collocations": collocations.op11_collocations,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_toxicity": toxicity.op13_toxicity,
}

LLM_ORACLES = {
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op7_topk_search": topk_search.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
}
