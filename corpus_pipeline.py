"""Corpus pipeline: language ID, n-gram dedup, suffix-array dedup, source mix, byte-level BPE.

Each stage is (spark, docs, sf_dir) -> DataFrame and is written as Parquet before the next reads it.
All but the last return the columns of ``documents``; the last adds the token counts and digests of
every text that is left.  A document that the mix takes twice is two rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spark_rca.llm import bpe, jaccard, langid, mixing, suffix_dedup
from spark_rca.llm.common import materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no learned language, go; null and empty texts too."""
    return langid.keep_identified(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document of least id stays; without words, all."""
    return jaccard.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose what strings of 400 bytes, or runs of over 50 words, that start twice cover; no row goes; null texts stay null."""
    return suffix_dedup.drop_repeats(docs, words=51)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in proportion to their sources' targets, none, once or up to three times; a null source is one source."""
    return mixing.mix_stage(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text; a null text has no token.

    Needs lang, source and n_chars, which stay with doc_id; text and other columns are dropped.
    """
    stay = ["doc_id", "lang", "source", "n_chars"]
    return bpe.encode(spark, docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, columns=stay, with_ids=False)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_dedup", drop_near_copies),
    ("suffix_dedup", drop_repeated_passages),
    ("source_mix", mix_to_targets),
    ("byte_bpe", encode_tokens),
]

#: A trained network and tiktoken's merges can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
