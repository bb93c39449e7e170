"""The queries of this folder, by registered name, and their DuckDB SQL."""

from __future__ import annotations

from . import bpe, html, language, minhash, mixing, quality, repeats, simhash, topk, toxicity

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_language": language.op3_language,
    "op4_bpe": bpe.op4_bpe,
    "op5_mix": mixing.op5_mix,
    "op6_quality": quality.op6_quality,
    "op7_minhash": minhash.op7_minhash,
    "op8_html": html.op8_html,
    "op9_topk": topk.op9_topk,
    "op10_repeats": repeats.op10_repeats,
}

ORACLES: dict[str, str] = {"op9_topk": topk.ORACLE}
