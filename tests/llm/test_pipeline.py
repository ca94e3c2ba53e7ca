import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from spark_rca.llm import bpe
from spark_rca.llm.common import materialize, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    cols = docs.columns
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))), special_tokens={})
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF))
        assert docs.columns == cols, name
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2] == sizes[3]
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], r["text"])
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(out) == sizes[4]
    for r in out:
        t = texts[r["doc_id"]]
        assert r["n_tokens"] == len(ref.encode_ordinary(t)) and r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_empty_input(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF))
    assert docs.count() == 0
