"""The queries of this subpackage and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from . import chat_format, divergence, exact_dedup, license_scan, lm_score, minhash, mixing, ngram_join, sentencepiece_codec, suffix_dedup, syncmers, toxicity, vector_codes

QUERIES = {
    f.__name__: f
    for f in (
        toxicity.op1_toxicity, lm_score.op2_lm_score, mixing.op3_mixing, license_scan.op4_license_scan, ngram_join.op5_ngram_join,
        suffix_dedup.op6_suffix_dedup, exact_dedup.op7_exact_dedup, syncmers.op8_syncmers, chat_format.op9_chat_format, sentencepiece_codec.op10_sentencepiece,
        minhash.op11_minhash, vector_codes.op12_vector_codes, divergence.op13_divergence,
    )
}

ORACLES = {"op7_exact_dedup": exact_dedup.ORACLE, "op9_chat_format": chat_format.ORACLE, "op12_vector_codes": vector_codes.ORACLE, "op13_divergence": divergence.ORACLE}
