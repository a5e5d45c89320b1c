"""Queries of the corpus operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import exact_dedup, gif, language_id, minhash, mixing, packing, secret_scan, tokens, url_filter, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_media_gif": gif.op6_media_gif,
    "op7_language_id": language_id.op7_language_id,
    "op8_mixing": mixing.op8_mixing,
    "op9_minhash": minhash.op9_minhash,
    "op10_token_counts": tokens.op10_token_counts,
}

ORACLES = {
    "op1_warc": warc.OP1_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op9_minhash": minhash.OP9_SQL,
}
