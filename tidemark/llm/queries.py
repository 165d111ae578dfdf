"""The numbered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, chat, html_extraction, language_id, lexical_search, mixing, nearest, ngram_join, quality_classifier, quality_rules, sentencepiece_bpe, sharding, toxicity

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_sentencepiece": sentencepiece_bpe.op2_sentencepiece,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_html_extraction": html_extraction.op5_html_extraction,
    "op6_nearest": nearest.op6_nearest,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_language_id": language_id.op9_language_id,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_sharding": sharding.op11_sharding,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_token_alignment": alignment.op13_token_alignment,
}

ORACLE_SQL = {
    "op1_chat_format": chat.OP1_SQL,
    "op3_quality_rules": quality_rules.OP3_SQL,
    "op8_ngram_join": ngram_join.OP8_SQL,
    "op10_mix_sources": mixing.OP10_SQL,
    "op11_sharding": sharding.OP11_SQL,
    "op12_lexical_search": lexical_search.OP12_SQL,
}
