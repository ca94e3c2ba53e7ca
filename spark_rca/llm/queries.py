"""Registered queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spark_rca.llm import align_tokens, bpe, chat, embedding_dedup, html_text, jaccard, langid, mixing, periodic, quality, simhash, suffix_dedup, toxicity
from spark_rca.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": lambda s, d: langid.language_query(s, table(s, d, "documents")),
        "op2_byte_bpe": lambda s, d: bpe.bpe_query(s, table(s, d, "documents")),
        "op3_simhash": lambda s, d: simhash.fingerprint_query(table(s, d, "documents")),
        "op4_html_text": lambda s, d: html_text.html_query(table(s, d, "pages")),
        "op5_toxicity": lambda s, d: toxicity.toxicity_query(s, table(s, d, "documents"), table(s, d, "labels")),
        "op6_suffix_dedup": lambda s, d: suffix_dedup.suffix_query(table(s, d, "documents")),
        "op7_embedding_dedup": lambda s, d: embedding_dedup.embedding_query(s, table(s, d, "embeddings")),
        "op8_chat_windows": lambda s, d: chat.chat_query(s, table(s, d, "conversations")),
        "op9_source_mix": lambda s, d: mixing.mix_query(table(s, d, "documents")),
        "op10_jaccard_join": lambda s, d: jaccard.jaccard_components(table(s, d, "documents")),
        "op11_periodic_runs": lambda s, d: periodic.periodic_query(table(s, d, "documents")),
        "op12_token_alignment": lambda s, d: align_tokens.align_query(s, table(s, d, "documents")),
        "op13_quality_rules": lambda s, d: quality.quality_query(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_source_mix": mixing.MIX_SQL}
