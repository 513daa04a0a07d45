"""Registered queries of this folder and their SQL."""

from __future__ import annotations

from pairloom.llm import (
    bpe, chat, exact, fm_index, langid, lexical, line_dedup, ngram_join, packing, page_text, quality, wavelet, whitening,
)

QUERIES = {
    "op1_byte_level_bpe": bpe.query,
    "op2_language_id": langid.query,
    "op3_line_dedup": line_dedup.query,
    "op4_chat_format": chat.query,
    "op5_exact_dedup": exact.query,
    "op6_ngram_jaccard_join": ngram_join.query,
    "op7_wavelet_shards": wavelet.query,
    "op8_best_fit_packing": packing.query,
    "op9_html_text": page_text.query,
    "op10_quality_cascade": quality.query,
    "op11_fm_decontamination": fm_index.query,
    "op12_lexical_search": lexical.query,
    "op13_embedding_whitening": whitening.query,
}

ORACLE = {
    "op3_line_dedup": line_dedup.SQL,
    "op4_chat_format": chat.SQL,
    "op5_exact_dedup": exact.SQL,
    "op10_quality_cascade": quality.SQL,
    "op11_fm_decontamination": fm_index.SQL,
    "op12_lexical_search": lexical.SQL,
}
