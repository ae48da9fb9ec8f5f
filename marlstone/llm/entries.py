"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from marlstone.llm import bpe, langid, mixing, neardup, passages, pii, quality, urlfilter, vectors


def queries() -> dict:
    return {
        "op1_embedding_dedup": vectors.op1_embedding_dedup,
        "op2_url_filter": urlfilter.op2_url_filter,
        "op3_repeats": passages.op3_repeats,
        "op4_near_dedup": neardup.op4_near_dedup,
        "op5_nearest": vectors.op5_nearest,
        "op6_language_id": langid.op6_language_id,
        "op7_quality": quality.op7_quality,
        "op8_mix": mixing.op8_mix,
        "op9_pii": pii.op9_pii,
        "op10_bpe": bpe.op10_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": urlfilter.OP2_SQL, "op8_mix": mixing.OP8_SQL}
