"""Quality rules against counting every n-gram of random texts, and on odd input."""

import random
import re

from pyspark.sql import functions as F

from spark_rca.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(words, k):
    """Places of each string of k words."""
    out = {}
    for i in range(len(words) - k + 1):
        out.setdefault(tuple(words[i : i + k]), []).append(i)
    return [v for v in out.values() if len(v) > 1]


def brute(text, least):
    w = WORD.findall(text)
    cover = lambda k: len({j for v in grams(w, k) for i in v for j in range(i, i + k)})
    lines = [x for x in text.split("\n") if WORD.search(x)]
    longest = 0
    while grams(w, longest + 1):
        longest += 1
    around = lambda i: w[i] if 0 <= i < len(w) else None
    maximal = sum(len({around(i - 1) for i in v}) > 1 and len({around(i + k) for i in v}) > 1 for k in range(least, longest + 1) for v in grams(w, k))
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), cover(3), maximal, cover(least), longest if longest >= least else 0


def random_texts(seed):
    rng = random.Random(seed)
    out = ["", " \n \n", "a", "a\na\n a\n\n", "é é é é é é", "# $ %", "a " * 400, "a b " * 300, ("p q r s t u v w x y z " * 2 + "\n") * 3]
    for _ in range(80):
        names = rng.choice([["a"], ["a", "b"], ["a", "é#", "日本", "x y\n", "q\n"], [f"w{i}" for i in range(30)]])
        out.append(rng.choice([" ", "\n", " \t"]).join(rng.choice(names) for _ in range(rng.randint(0, 90))))
    return out


def test_equals_counting(spark):
    texts = random_texts(1)
    for least in (2, 10):
        d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        for r in quality.repetition_rules(d, min_words=least, max_covered_percent=30, max_repeat=12, least_words=5).collect():
            n, chars, symbols, dup, rep, maximal, cov, longest = want = brute(texts[r["doc_id"]], least)
            assert tuple(r[c] for c in (*quality.BASE, "n_repeats", "n_covered_words", "longest_repeat")) == want, texts[r["doc_id"]]
            assert r["base_failed"] == (n < 5 or 100 * rep > 50 * n)
            assert r["kept"] == (not r["base_failed"] and 100 * cov <= 30 * n and longest <= 12)


def test_repeated_passages_go_and_prose_stays(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passage, block = prose(40), prose(230)
    texts = {1: prose(400), 2: f"{prose(30)} {passage} {prose(30)} {passage} {prose(20)}", 3: f"{block} {prose(2000)} {block}", 4: f"{passage} {prose(300)} {passage}", 5: prose(49), 6: prose(50)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in quality.keep_unrepetitive(d).collect()} == {1, 4, 6}
    got = {r["doc_id"]: r for r in quality.quality_query(d).collect()}
    assert got[3]["longest_repeat"] == 230 and not got[3]["base_failed"] and got[5]["base_failed"]


def test_odd_input(spark):
    long = "one two three four five six seven " * 30_000
    rows = [(1, None), (1, None), (None, "a b"), (2, ""), (3, long), (3, long)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("N_words", F.lit("x")).withColumn("key", F.lit("own"))
    out = quality.repetition_rules(d)
    got = out.collect()
    assert out.columns[:3] == ["doc_id", "text", "key"] and len(got) == 6 and all(r["key"] == "own" for r in got)
    assert [r["n_words"] for r in got if r["text"] is None] == [0, 0] and not any(r["kept"] for r in got)
    assert {(r["n_words"], r["longest_repeat"], r["n_repeat_words"]) for r in got if r["doc_id"] == 3} == {(210_000, 209_993, 210_000)}
    assert quality.quality_query(d.limit(0)).collect() == []
