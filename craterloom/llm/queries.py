"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from craterloom.llm import bpe, chat, exact_dedup, langid, licenses, near_dedup, packing, suffix_array, topk, wavelet

QUERIES = {
    f.__name__: f
    for f in (
        chat.op1_preference_format,
        langid.op2_language_id,
        suffix_array.op3_suffix_array_dedup,
        bpe.op4_bpe_stream,
        wavelet.op5_wavelet_shards,
        licenses.op6_license_scan,
        packing.op7_best_two_fit,
        exact_dedup.op8_grace_dedup,
        near_dedup.op9_minhash_bayes,
        topk.op10_ball_tree_topk,
    )
}

ORACLES = {
    "op1_preference_format": chat.ORACLE,
    "op8_grace_dedup": exact_dedup.ORACLE,
    "op10_ball_tree_topk": topk.ORACLE,
}
