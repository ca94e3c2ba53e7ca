"""Toxicity judged on rows that the chain has not learned from, and a trained chain on odd input."""

import pytest
from pyspark.sql import functions as F

from spark_rca.llm import common, toxicity


@pytest.fixture(scope="module")
def tables(spark):
    d = common.table(spark, "/root/testdata/sf0.1", "documents")
    lab = common.table(spark, "/root/testdata/sf0.1", "labels")
    half = F.crc32(F.col("doc_id").cast("string")) % 2
    return d, lab.where(half == 0), lab.where(half == 1)


@pytest.fixture(scope="module")
def chain(spark, tables):
    d, learned, _ = tables
    return toxicity.train_chain(d, learned)


def test_held_out_rows(spark, tables, chain):
    """Texts that are copies of learned ones are left out of the judgement."""
    d, learned, held = tables
    seen = d.join(learned.select("doc_id"), "doc_id", "left_semi").select("text").distinct()
    rows = d.join(held.select("doc_id", F.col("toxic").alias("y")), "doc_id").join(seen, "text", "left_anti").select("doc_id", "text", "y")
    got = toxicity.predict_toxicity(spark, rows, chain).select("y", (F.col("p_toxic") >= 0.5).alias("toxic")).collect()
    toxic, clean = [r["toxic"] for r in got if r["y"] == 1], [r["toxic"] for r in got if r["y"] == 0]
    print(f"toxic {sum(toxic)} of {len(toxic)}, clean {sum(clean)} of {len(clean)}")
    assert len(toxic) > 100 and len(clean) > 1000
    # Half of the labels have about 200 toxic rows in four languages; a term needs four of them.  Measured: 183 of 199.
    assert sum(toxic) / len(toxic) >= 0.9 and sum(clean) / len(clean) < 0.005


def test_a_trained_chain_on_odd_input(spark, tables, chain):
    d, learned, _ = tables
    bad = d.join(learned.where("toxic = 1").select("doc_id"), "doc_id", "left_semi").orderBy("doc_id").first()["text"]
    rows = [(1, None, "a"), (2, "", None), (3, bad, "b"), (3, bad, "b"), (4, "word " * 200_000, "c"), (5, "x" * 300_000, "d"), (None, bad, "e"), (6, "\x00 \U0001f600 ", "f")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, hits string").withColumn("p_toxic", F.lit("taken"))
    got = toxicity.predict_toxicity(spark, odd, chain).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "hits", *[f"p_{c}" for c in toxicity.CATEGORIES]}
    p = {(r["doc_id"], r["hits"]): r["p_toxic"] for r in got}
    plain = p[1, "a"]
    assert p[2, None] == p[5, "d"] == p[6, "f"] == plain and plain < 0.5
    assert p[3, "b"] == p[None, "e"] > 0.5
    assert [r["text"] for r in got if r["doc_id"] == 4] == ["word " * 200_000]
    assert toxicity.predict_toxicity(spark, odd.limit(0), chain).collect() == []
