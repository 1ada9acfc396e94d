"""Registered queries of this subpackage and the SQL that checks them, where SQL can."""

from __future__ import annotations

from panelwise.llm import (
    bottom_k, decontamination, fingerprints, html_text, language_id, language_model, licences, ngram_join, packing, prefix_trie,
    pseudonyms, ranked_search, toxicity,
)

QUERIES = {
    "op1_benchmark_decontamination": decontamination.query,
    "op2_best_fit_packing": packing.query,
    "op3_html_extraction": html_text.query,
    "op4_pii_pseudonyms": pseudonyms.query,
    "op5_lm_scores": language_model.query,
    "op6_language_id": language_id.query,
    "op7_fingerprints": fingerprints.query,
    "op8_toxicity": toxicity.query,
    "op9_ngram_jaccard_join": ngram_join.query,
    "op10_license_scan": licences.query,
    "op11_minhash_near_dedup": bottom_k.query,
    "op12_conversation_trie": prefix_trie.query,
    "op13_ranked_search": ranked_search.query,
}

SQL = {
    "op1_benchmark_decontamination": decontamination.SQL,
    "op10_license_scan": licences.SQL,
    "op11_minhash_near_dedup": bottom_k.SQL,
    "op12_conversation_trie": prefix_trie.SQL,
    "op13_ranked_search": ranked_search.SQL,
}
