"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from worklens.llm import chat_format, decontaminate, jaccard_join, mix_sources, periodic_runs, quality_rules, secret_scan, shard, spelling_variants, suffix_dedup, topk_search, url_filter, wrapper_induction

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_topk_search": topk_search.op3_topk_search,
    "op4_histogram_sort": shard.op4_histogram_sort,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_mix_sources": mix_sources.op9_mix_sources,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_spelling_variants": spelling_variants.op11_spelling_variants,
    "op12_html_extraction": wrapper_induction.op12_html_extraction,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

ORACLES = {"op2_chat_format": chat_format.ORACLE, "op3_topk_search": topk_search.ORACLE}
