"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from latewing.llm import alignment, divergence, htmltext, jaccard, mixing, packing, passages, pii, quality, tokenfile, topk, toxicity, urlrules

QUERIES = {
    "op1_token_files": tokenfile.op1,
    "op2_personal_data": pii.op2,
    "op3_main_text": htmltext.op3,
    "op4_mix_sources": mixing.op4,
    "op5_quality_rules": quality.op5,
    "op6_shared_passages": passages.op6,
    "op7_url_rules": urlrules.op7,
    "op8_pivot_top_k": topk.op8,
    "op9_best_two_fit": packing.op9,
    "op10_jaccard_join": jaccard.op10,
    "op11_token_alignment": alignment.op11,
    "op12_toxicity": toxicity.op12,
    "op13_source_divergence": divergence.op13,
}

SQL: dict[str, str] = {
    "op4_mix_sources": mixing.SQL,
    "op7_url_rules": urlrules.SQL,
    "op8_pivot_top_k": topk.SQL,
    "op10_jaccard_join": jaccard.SQL,
    "op13_source_divergence": divergence.SQL,
}
