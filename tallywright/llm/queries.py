"""The queries of this subpackage and, where SQL expresses them, their SQL."""

from __future__ import annotations

from . import decontam, embedding_links, html_text, mixing, pii, repeats, rollup, sharding, shingle_join, toxicity

QUERIES = {
    "op1_embedding_links": embedding_links.op1_embedding_links,
    "op2_sharding": sharding.op2_sharding,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_pii": pii.op4_pii,
    "op5_repeats": repeats.op5_repeats,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_html_text": html_text.op7_html_text,
    "op8_mixing": mixing.op8_mixing,
    "op9_token_rollup": rollup.op9_token_rollup,
    "op10_shingle_join": shingle_join.op10_shingle_join,
}

ORACLES = {
    "op1_embedding_links": embedding_links.SQL,
    "op8_mixing": mixing.SQL,
    "op9_token_rollup": rollup.SQL,
    "op10_shingle_join": shingle_join.SQL,
}
