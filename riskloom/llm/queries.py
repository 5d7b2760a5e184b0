"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import importance, language, mixing, nearest, packing, piece_codec, quality_rules, ranked_search, simhash, token_counts, toxicity, url_rules, vector_groups

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_groups": simhash.op1_simhash_groups,
    "op2_language": language.op2_language,
    "op3_piece_round_trip": piece_codec.op3_piece_round_trip,
    "op4_source_mix": mixing.op4_source_mix,
    "op5_url_verdicts": url_rules.op5_url_verdicts,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_nearest": nearest.op7_nearest,
    "op8_packed_rows": packing.op8_packed_rows,
    "op9_vector_groups": vector_groups.op9_vector_groups,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_quality": quality_rules.op11_quality,
    "op12_ranked_search": ranked_search.op12_ranked_search,
    "op13_importance_draw": importance.op13_importance_draw,
}

ORACLE_SQL: dict[str, str] = {
    "op5_url_verdicts": url_rules.ORACLE,
    "op11_quality": quality_rules.ORACLE,
    "op12_ranked_search": ranked_search.ORACLE,
    "op13_importance_draw": importance.ORACLE,
}
