"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from . import decontaminate, divergence, extract, lm, mixing, neardup, periodic, pii, quality, sharding, tokencount, tokenindex, urls

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_tokencount": tokencount.op2_tokencount,
    "op3_lm": lm.op3_lm,
    "op4_sharding": sharding.op4_sharding,
    "op5_quality": quality.op5_quality,
    "op6_jaccard": neardup.op6_jaccard,
    "op7_tokens": tokenindex.op7_tokens,
    "op8_urls": urls.op8_urls,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_extract": extract.op10_extract,
    "op11_divergence": divergence.op11_divergence,
    "op12_pii": pii.op12_pii,
    "op13_periodic": periodic.op13_periodic,
}

ORACLE = {
    "op1_mixing": mixing.ORACLE_SQL,
    "op11_divergence": divergence.ORACLE_SQL,
    "op12_pii": pii.ORACLE_SQL,
}
