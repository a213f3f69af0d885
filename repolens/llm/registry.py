"""The dealt queries and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from . import bitplanes, exact_dedup, language, mixing, ogg, packing, quality, simhash, substring_dedup, toxicity

QUERIES = {
    "op1_ogg": ogg.op1_ogg,
    "op2_best_fit": packing.op2_best_fit,
    "op3_golay": simhash.op3_golay,
    "op4_ordinal": quality.op4_ordinal,
    "op5_bitplanes": bitplanes.op5_bitplanes,
    "op8_levenshtein": toxicity.op8_levenshtein,
    "op9_hierarchical": mixing.op9_hierarchical,
    "op10_hyperdimensional": language.op10_hyperdimensional,
    "op6_suffix": substring_dedup.op6_suffix,
    "op7_patricia": exact_dedup.op7_patricia,
}

ORACLE = {
    "op7_patricia": exact_dedup.OP7_SQL,
}
