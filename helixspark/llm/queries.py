"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from helixspark.llm import conversations, decontaminate, exact, jaccard, lines, merkle, packing, quality, rules, suffix, tokens, toxicity, urls


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_query,
        "op2_line_dedup": lines.op2_query,
        "op3_best_fit_packing": packing.op3_query,
        "op4_ngram_jaccard": jaccard.op4_query,
        "op5_suffix_dedup": suffix.op5_query,
        "op6_url_filter": urls.op6_query,
        "op7_quality_rules": rules.op7_query,
        "op8_token_counts": tokens.op8_query,
        "op9_quality_classifier": quality.op9_query,
        "op10_decontaminate": decontaminate.op10_query,
        "op11_conversation_repair": conversations.op11_query,
        "op12_exact_dedup": exact.op12_query,
        "op13_merkle_manifest": merkle.op13_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": lines.OP2_SQL,
        "op6_url_filter": urls.OP6_SQL,
        "op7_quality_rules": rules.OP7_SQL,
        "op10_decontaminate": decontaminate.OP10_SQL,
        "op11_conversation_repair": conversations.OP11_SQL,
        "op12_exact_dedup": exact.OP12_SQL,
        "op13_merkle_manifest": merkle.OP13_SQL,
    }
