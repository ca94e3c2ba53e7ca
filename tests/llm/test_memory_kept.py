import gc
import re

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from spark_rca.llm import bpe, suffix_dedup
from spark_rca.llm.common import lean


def test_no_encoder_stays_in_a_worker_of_other_operators(spark):
    def encoders(it):
        for _ in it:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ == "Encoder" for x in gc.get_objects())], pa.int64())], ["n"])

    docs = spark.range(0, 40, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for _ in range(2):  # tasks of one operator share it, in any order
        assert bpe.encode(spark, docs, path, public_tokenizers.PATTERN).where("n_tokens > 2").count() == 40
        assert {r["n"] for r in spark.range(0, 40, 1, 4).mapInArrow(lean(encoders), "n long").collect()} == {0}


def test_only_named_columns_come_back(spark):
    shared = "passage " * 60
    docs = spark.createDataFrame([(1, f"a{shared}b"), (2, f"c{shared}d"), (3, None), (4, "alone")], "doc_id long, text string")
    out = suffix_dedup.remove_repeats(docs, names=(None, None, "gone", None, "left"))
    assert out.columns == ["doc_id", "text", "gone", "left"]
    assert {(r["doc_id"], r["gone"], r["left"]) for r in out.collect()} == {(1, 480, "ab"), (2, 480, "cd"), (3, 0, None), (4, 0, None)}


def test_encoder_takes_words_but_no_text_and_returns_no_ids(spark):
    """Workers of the last stage and of op2 hold neither a second copy of each text nor ids that nobody asks for."""
    docs = spark.createDataFrame([(1, "some words", "en", "web", 10), (2, None, None, None, 0), (3, "", "en", "web", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for out in (corpus_pipeline.encode_tokens(spark, docs, ""), bpe.bpe_query(spark, docs)):
        (line,) = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in x]
        assert "_words#" in line and not re.search(r"\b(text|ids)#", line)
        assert {r["doc_id"]: r["n_tokens"] for r in out.collect()} == {1: 2, 2: 0, 3: 0}
    whole = bpe.encode(spark, docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert whole.columns == [*docs.columns, "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    got = {r["doc_id"]: r for r in whole.collect()}
    assert got[1]["text"] == "some words" and len(got[1]["ids"]) == 8 and got[2]["text"] is None and got[2]["ids"] == b""
