"""The operators' named queries, with SQL where SQL can express them."""

from __future__ import annotations

from sparkodds.llm import align, arc, forest, jaccard_join, lang_id, licences, line_dedup, mixing, sanitise, spelling, tokenise, topk, toxicity

QUERIES = {
    "op1_lang_id": lang_id.op1_lang_id,
    "op2_mixing": mixing.op2_mixing,
    "op3_licences": licences.op3_licences,
    "op4_top_k": topk.op4_top_k,
    "op5_sampled_pieces": tokenise.op5_sampled_pieces,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_forest": forest.op8_forest,
    "op9_jaccard": jaccard_join.op9_jaccard,
    "op10_warc": arc.op10_warc,
    "op11_personal_data": sanitise.op11_personal_data,
    "op12_variants": spelling.op12_variants,
    "op13_align": align.op13_align,
}

ORACLES = {
    "op2_mixing": mixing.OP2_SQL,
    "op3_licences": licences.OP3_SQL,
    "op4_top_k": topk.OP4_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op9_jaccard": jaccard_join.OP9_SQL,
    "op10_warc": arc.OP10_SQL,
}
