import hashlib
import os
import random
import re
from collections import Counter

import corpus_pipeline
from spark_rca.llm import common, suffix_dedup
from spark_rca.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_chars long"


def own(r, n):
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n))


def test_stage_takes_short_passages_of_over_50_words(spark):
    """A passage of 51 words and under 400 bytes goes from every document, across white space; one of 50 words stays."""
    r = random.Random(5)
    passage, fifty = [own(r, n).split() for n in (51, 50)]
    assert len(" ".join(passage)) < 400
    texts = [(0, f"{(a := own(r, 80))} {' '.join(passage)} {(b := own(r, 9))}"), (1, "été " + "\n".join(passage)), (2, f"{own(r, 9)} {' '.join(fifty)} {own(r, 70)}"), (3, f"{own(r, 8)} {' '.join(fifty)} {own(r, 7)}"), (4, None)]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in texts], SCHEMA)
    got = {x["doc_id"]: x for x in corpus_pipeline.drop_repeated_passages(spark, docs, SF).collect()}
    assert got[0]["text"] == f"{a}  {b}" and got[0]["n_chars"] == len(a) + len(b) + 2
    assert got[1]["text"] == "été "
    assert [got[i]["text"] for i in (2, 3, 4)] == [dict(texts)[i] for i in (2, 3, 4)]


def cover(texts, length, words):
    """What is left if repeated strings go, and words of repeated runs with the white space between them."""
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    lists = [[t[a:b] for a, b in at] for t, at in zip(texts, spans, strict=True)]
    strings = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    runs = Counter(tuple(w[i : i + words]) for w in lists for i in range(len(w) - words + 1))
    out = []
    for t, at, w in zip(texts, spans, lists, strict=True):
        gone, taken = bytearray(len(t)), [False] * len(w)
        for i in range(len(t) - length + 1):
            if strings[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        for i in range(len(w) - words + 1):
            if runs[tuple(w[i : i + words])] > 1:
                taken[i : i + words] = [True] * words
        for i, (a, b) in enumerate(at):
            if taken[i]:
                end = at[i + 1][0] if i + 1 < len(at) and taken[i + 1] else b
                gone[a:end] = b"\1" * (end - a)
        out.append(bytes(c for c, g in zip(t, gone, strict=True) if not g))
    return out


def test_words_and_bytes_equal_brute_force(spark):
    rows = table(spark, SF, "documents").orderBy("doc_id").limit(60).collect()
    r = random.Random(3)
    odd = ["", None, "a " * 300, "a b " * 200, "\n\t ", own(r, 60), own(r, 40)]
    odd += [f"{odd[5]} x", f"y {odd[6]}  z"]
    texts = {x["doc_id"]: x["text"] for x in rows} | {10**6 + i: t for i, t in enumerate(odd)}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    for length, words, hot in ((400, 51, suffix_dedup.HOT), (60, 5, 2000)):
        want = dict(zip(texts, cover([(t or "").encode() for t in texts.values()], length, words), strict=True))
        got = {x["doc_id"]: bytes(x["_kept"]) for x in suffix_dedup.remove_repeats(docs, length, hot, words=words).collect()}
        assert got == want


def test_op6_tells_short_passages_that_its_contract_keeps(spark):
    """A passage of 51 words and under 400 bytes stays and is told, across white space; one of 50 words isn't."""
    r = random.Random(7)
    passage, fifty = [own(r, n).split() for n in (51, 50)]
    long = own(r, 120)
    assert len(" ".join(passage)) < 400 < len(long)
    texts = [f"{own(r, 80)} {' '.join(passage)} {own(r, 9)}", "été " + "\n".join(passage), f"{own(r, 9)} {' '.join(fifty)}", f"{own(r, 8)} {' '.join(fifty)} z", f"{long} x", f"y {long}", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in suffix_dedup.suffix_query(docs).collect()}
    assert [got[i]["n_passage_words"] for i in range(7)] == [51, 51, 0, 0, 120, 120, 0]
    assert [got[i]["has_passage"] for i in range(7)] == [True, True, False, False, True, True, False]
    assert [got[i]["has_repeats"] for i in range(7)] == [False, False, False, False, True, True, False]
    for i, t in enumerate(texts[:4]):
        assert (got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (0, 0, hashlib.sha256(t.encode()).hexdigest())


def test_expansion_over_codes_equals_brute_force():
    r = random.Random(9)
    for length in (1, 2, 5, 12):
        pieces = [[r.choice((b"abcdef", b"bbcdef", b"\0\0\0\0\0\0")) for _ in range(r.randint(12, 60))] for _ in range(5)]
        seen = Counter(tuple(p[s : s + length]) for p in pieces for s in range(len(p) - length + 1))
        want, at = [], 0
        for p in pieces:
            want += [at + s for s in range(len(p) - length + 1) if seen[tuple(p[s : s + length])] > 1]
            at += len(p) + 1
        assert suffix_dedup.repeated_starts([b"".join(p) for p in pieces], length, unit=6).tolist() == want


def test_tables_on_the_way_are_deleted(spark):
    def make():
        return common.materialize(common.materialize(spark.range(9)).where("id > 4"))

    before = set(os.listdir(common.shared_dir(spark)))
    out = common.materialize_alone(spark, make)
    assert len(set(os.listdir(common.shared_dir(spark))) - before) == 1
    assert sorted(r["id"] for r in out.collect()) == [5, 6, 7, 8]
