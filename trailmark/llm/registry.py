"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailmark.llm import crosstoken, decontaminate, jaccardjoin, langid, linededup, media, mixing, neardup, pseudonyms, resampling, secrets, toxicity, transcripts

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_feistel_pseudonyms": pseudonyms.op1_feistel_pseudonyms,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_media_archive": media.op3_media_archive,
        "op4_probminhash_near_dedup": neardup.op4_probminhash_near_dedup,
        "op5_language_id": langid.op5_language_id,
        "op6_line_dedup": linededup.op6_line_dedup,
        "op7_poisson_mixing": mixing.op7_poisson_mixing,
        "op8_transcript_roles": transcripts.op8_transcript_roles,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_winnowing_decontamination": decontaminate.op10_winnowing_decontamination,
        "op11_importance_resampling": resampling.op11_importance_resampling,
        "op12_token_alignment": crosstoken.op12_token_alignment,
        "op13_jaccard_join": jaccardjoin.op13_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secret_scan": secrets.OP2_SQL,
        "op6_line_dedup": linededup.OP6_SQL,
        "op7_poisson_mixing": mixing.OP7_SQL,
        "op10_winnowing_decontamination": decontaminate.OP10_SQL,
        "op11_importance_resampling": resampling.OP11_SQL,
        "op13_jaccard_join": jaccardjoin.OP13_SQL,
    }
