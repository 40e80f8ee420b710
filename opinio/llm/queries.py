"""Registered queries of the operators, and their DuckDB SQL where it exists."""

from __future__ import annotations

import corpus_pipeline
from opinio.llm import chat, fill_middle, hnsw, licenses, mixing, ngram_join, pieces, pii, quality, suffix_dedup, toxicity, trie, urls

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_pii_surrogates": pii.op4_pii_surrogates,
    "op5_sentence_pieces": pieces.op5_sentence_pieces,
    "op6_source_mix": mixing.op6_source_mix,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_embedding_dedup": hnsw.op8_embedding_dedup,
    "op9_url_filter": urls.op9_url_filter,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_chat_format": chat.op11_chat_format,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_fill_in_middle": fill_middle.op13_fill_in_middle,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_license_scan": licenses.ORACLE,
    "op3_ngram_join": ngram_join.ORACLE,
    "op6_source_mix": mixing.ORACLE,
    "op11_chat_format": chat.ORACLE,
    "op12_prefix_trie": trie.ORACLE,
    "op13_fill_in_middle": fill_middle.ORACLE,
}
