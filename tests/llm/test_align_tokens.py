"""Cross-tokenizer alignment against a comparison of all token ranges of each text, and on odd input."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer, decoders

from spark_rca.llm import align_tokens

FILES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
DOC = "doc_id long, text string"
WORDS = ["alignment", "tokens", "naïve", "日本語", "🙂", "x1y2", "don't", "<|endoftext|>", "</s>", "<0x41>", "Straße", "12345", "\t", "\n\n", "  ", "\x00", "end."]


def ranges(sizes):
    out, at = [], 0
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


def brute(texts):
    """Rows (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of all texts."""
    a, b = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a.encode_special_tokens = True
    letters = align_tokens.byte_alphabet()
    rows, links, held = [], [], Counter()
    for t in texts:
        full = (" " + (t or "")).encode()
        e = a.encode(" " + (t or ""), add_special_tokens=False)
        left = [bytes(letters[c] for c in x) for x in e.tokens]
        ids = b.encode(t or "")
        right = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, map(b.id_to_piece, ids))]
        if not t or b"".join(left) != full or b"".join(right) != full:
            rows.append((0, 0, 0, ""))
            links.append([])
            continue
        ra, rb = ranges(map(len, left)), ranges(map(len, right))
        cuts = sorted({y for _, y in ra} & {y for _, y in rb})
        groups, at = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, (x, y) in zip(side, r) if at <= x and y <= c) for side, r in ((e.ids, ra), (ids, rb))))
            at = c
        links.append([(i, j) for i, (x, y) in zip(e.ids, ra) for j, (u, v) in zip(ids, rb) if x < v and u < y])
        held.update(set(links[-1]))
        rows.append((len(e.ids), len(ids), len(groups), ";".join(groups)))
    most = {}
    for (i, _), n in held.items():
        most[i] = max(most.get(i, 0), n)
    return [(na, nb, ng, len(got), sum(held[x] == most[x[0]] for x in got), sum(held[x] for x in got), groups) for (na, nb, ng, groups), got in zip(rows, links)]


def texts():
    rng = random.Random(4)
    out = [None, "", " ", "a", " a  b ", "▁ x", "a▁b", "ﬁ ½", "<unk> <s>", "x" * 300, "日本" * 80]
    return out + [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["tokens tokens"] * 3


def test_alphabet_is_the_byte_level_one():
    assert "".join(byte := [c for c, _ in sorted(align_tokens.byte_alphabet().items(), key=lambda x: x[1])]) and len(byte) == 256
    assert all(decoders.ByteLevel().decode([c, byte[0x41]]) == chr(b) + "A" for c, b in align_tokens.byte_alphabet().items() if b < 128)


@pytest.mark.parametrize("hot", [1_000_000, 40, 0])
def test_equals_all_ranges(spark, hot):
    data = texts()
    d = spark.createDataFrame(list(enumerate(data)), DOC).repartition(3)
    got = {r["doc_id"]: r for r in align_tokens.align_documents(spark, d, *FILES, public_tokenizers.PATTERN if hot else None, hot=hot).collect()}
    for i, want in enumerate(brute(data)):
        assert tuple(got[i][c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")) == want, data[i]


def test_ranks_give_the_tokenizers_ids():
    """The faster way against the tokenizer itself, on all kinds of characters and on a run too long for the pattern's engine."""
    rng = random.Random(9)
    blocks = [(32, 127), (160, 600), (0x370, 0x700), (0x900, 0xE00), (0x2000, 0x2100), (0x3040, 0x3100), (0x4E00, 0x5000), (0xAC00, 0xAD00), (0x1F300, 0x1F700), (9, 14)]
    many = [" " + "".join(chr(rng.randrange(*rng.choice(blocks))) for _ in range(rng.randint(0, 80))) for _ in range(2000)] + [" " + t for t in texts() if t]
    pair = align_tokens.Pair(open(FILES[0]).read(), open(FILES[1], "rb").read(), public_tokenizers.PATTERN)
    own = [x.ids for x in pair.a.encode_batch_fast(many, add_special_tokens=False)]
    assert pair.ranked is not None and pair.encode_a(many) == own
    run = [" " * 1_500_000 + "x", " a"]
    assert sum(map(len, (pair.a_bytes[i] for i in pair.encode_a(run)[0]))) == 1_500_001


def test_tasks_hand_on_full_counts(spark):
    d = spark.createDataFrame([(list(range(k, k + 30)),) for k in range(0, 200, 7)], "c array<int>").coalesce(1)
    with_limit = {tuple(r) for r in align_tokens.pair_counts(d, 10, "c", flush=20).collect()}
    assert with_limit == {tuple(r) for r in align_tokens.pair_counts(d, 10, "c").collect()}
    assert {r[0]: r[1] for r in with_limit} == Counter(x for k in range(0, 200, 7) for x in range(k, k + 30))


def test_query_and_odd_input(spark):
    rows = [(1, None), (1, None), (None, "no id"), (2, ""), (3, "long words " * 150), (3, "long words " * 150)]
    d = spark.createDataFrame(rows, DOC).withColumn("N_a", F.lit("x")).withColumn("_row", F.lit("own")).withColumn("code", F.lit(7)).withColumn("a", F.lit(8))
    out = align_tokens.align_documents(spark, d, *FILES)
    got = out.collect()
    assert out.columns == ["doc_id", "_row", "code", "a", *align_tokens.ADDED] and len(got) == 6 and all((r["_row"], r["code"], r["a"]) == ("own", 7, 8) for r in got)
    query = align_tokens.align_query(spark, d).collect()
    want = dict(zip([str(r) for r in rows], brute([t for _, t in rows])))
    for r in query:
        w = want[str(next(x for x in rows if x[0] == r["doc_id"]))]
        assert (r["n_a"], r["n_links"], r["count_sum"], r["groups_sha256"]) == (w[0], w[3], w[5], w[6] and hashlib.sha256(w[6].encode()).hexdigest())
    assert align_tokens.align_query(spark, d.limit(0)).collect() == []
    long = align_tokens.align_query(spark, spark.createDataFrame([(1, "long words " * 60_000)], DOC)).first()
    assert long["n_groups"] >= 120_000 and long["count_sum"] == long["n_links"]  # one text holds every pair
