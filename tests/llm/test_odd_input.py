"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spark_rca.llm import bpe, chat, embedding_dedup, html_text, jaccard, langid, mixing, simhash, suffix_dedup, toxicity
from spark_rca.llm.common import materialize

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves, or could.
CLASH = ["key", "_key", "spans", "_spans", "_s", "_size", "_words", "_letters", "_hits", "_text", "n_tokens", "bucket", "sid", "h1", "_keep", "_n", "_copies", "rate", "_rate", "_own", "region", "label"]
LONG = "long text with many words " * 6000


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "Some text of words that is here twice", "en", "a", 9), (1, "Some text of words that is here twice", "en", "a", 9), (2, None, "en", None, None), (3, "", None, "b", 0), (None, "no id but words", "de", "b", 3)]
    rows += [(4, LONG, "en", "a", len(LONG)), (5, " \t", "en", "c", 2), (6, "Some text of words that is here twice", None, None, 9), (None, None, None, None, None), (1, "the same id with another text", "en", "a", 1)]
    return spark.createDataFrame(rows, DOC)


def wide(df):
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])


TOKENS = lambda: (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
ON_DOCS = {
    "langid": lambda s, d: langid.predict_language(s, d, langid.train_language_model(langid.labelled(d))),
    "keep_identified": langid.keep_identified,
    "encode": lambda s, d: bpe.encode(s, d, *TOKENS()),
    "toxicity": lambda s, d: toxicity.predict_toxicity(s, d, None),
    "remove_repeats": lambda s, d: suffix_dedup.remove_repeats(d),
    "drop_repeats": lambda s, d: suffix_dedup.drop_repeats(d),
    "mix": lambda s, d: mixing.mix_stage(d),
    "keep_one": lambda s, d: jaccard.keep_one(d),
}


@pytest.mark.parametrize("name", sorted(ON_DOCS))
def test_clashing_columns_stay(spark, odd, name):
    d = wide(odd)
    out = ON_DOCS[name](spark, d)
    added = set(out.columns) - set(d.columns)
    assert [c for c in out.columns if c not in added | set(bpe.ADDED)] == [c for c in d.columns if c not in bpe.ADDED]
    rows = out.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in CLASH if not (name == "encode" and c in bpe.ADDED))
    plain = ON_DOCS[name](spark, odd).collect()
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    assert sorted(map(key, rows)) == sorted(map(key, plain))


@pytest.mark.parametrize("name", sorted(ON_DOCS))
def test_empty_documents(spark, odd, name):
    assert ON_DOCS[name](spark, odd.limit(0)).collect() == []


def test_other_empty_tables(spark, odd):
    e = odd.limit(0)
    assert simhash.fingerprint_query(e).collect() == [] and suffix_dedup.suffix_query(e).collect() == [] and mixing.mix_query(e).collect() == []
    assert jaccard.jaccard_components(e).collect() == [] and langid.language_query(spark, e).collect() == [] and bpe.bpe_query(spark, e).collect() == []
    assert toxicity.toxicity_query(spark, e, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
    assert html_text.html_query(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    assert embedding_dedup.embedding_query(spark, spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).collect() == []
    own = chat.chat_query(spark, spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect()
    assert [r["conv_id"] for r in own] == [-7]


def test_repeated_rows(spark, odd):
    """Ids repeat with equal and with other texts; rows without an id are kept apart."""
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.jaccard_components(odd).collect()}
    assert got[6, 6] == got[1, 6] == got[1, 4] == 1 and got[2, 0] == 2 and got[3, 0] == 3
    assert [r for r in jaccard.jaccard_components(odd).collect() if r["doc_id"] is None and r["component_id"] is not None] == []
    kept = [(r["doc_id"], r["text"]) for r in jaccard.keep_one(odd).collect()]
    assert sorted(i for i, _ in kept if i is not None) == [1, 1, 2, 3, 4, 5] and sum(i is None for i, _ in kept) == 2 and len(set(kept)) == len(kept)
    assert sorted(t for i, t in kept if i == 1) == ["Some text of words that is here twice", "the same id with another text"]
    size = odd.count()
    for q in (simhash.fingerprint_query, suffix_dedup.suffix_query, mixing.mix_query):
        assert q(odd).count() == size
    assert langid.language_query(spark, odd).count() == bpe.bpe_query(spark, odd).count() == size


def test_replacement_characters_of_a_text_stay(spark):
    """Only characters that a cut parts go."""
    shared = "é" * 300
    d = spark.createDataFrame([(1, f"a\N{REPLACEMENT CHARACTER}b{shared}c"), (2, f"xy{shared}\N{REPLACEMENT CHARACTER}")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.drop_repeats(d).collect()}
    assert got == {1: "a\N{REPLACEMENT CHARACTER}bc", 2: "xy\N{REPLACEMENT CHARACTER}"}


def test_stages_on_odd_input(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""))
    assert {r["doc_id"] for r in docs.collect()} <= {1, 4, None}
