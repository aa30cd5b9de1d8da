"""The queries of this package for __spark_entry__.py, with their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from . import bestfit_pack, chat_format, curriculum_mix, hilbert_shards, language_id, line_dedup, lm_score, ngram_join, telephony_audio, threshold_search

QUERIES = {
    "op1_threshold_search": threshold_search.op1_threshold_search,
    "op2_bestfit_pack": bestfit_pack.op2_bestfit_pack,
    "op3_curriculum_mix": curriculum_mix.op3_curriculum_mix,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_language_id": language_id.op5_language_id,
    "op6_lm_score": lm_score.op6_lm_score,
    "op7_telephony_audio": telephony_audio.op7_telephony_audio,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_hilbert_shards": hilbert_shards.op9_hilbert_shards,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

ORACLES = {
    "op1_threshold_search": threshold_search.ORACLE,
    "op3_curriculum_mix": curriculum_mix.ORACLE,
    "op4_ngram_join": ngram_join.ORACLE,
    "op8_chat_format": chat_format.ORACLE,
    "op9_hilbert_shards": hilbert_shards.oracle(),
    "op10_line_dedup": line_dedup.ORACLE,
}
