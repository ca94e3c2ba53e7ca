"""Periodic runs against a scan of every period of each text, and on odd input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spark_rca.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string"


def planted(i, text):
    w, h = WORD.findall(text), zlib.crc32(str(i).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k if k < a else a + (k - a) % p] for k in range(n)]
    return w


def brute(w):
    """Every maximal stretch with a period, at its smallest period, of at least 4 periods and 6 words."""
    out, n = {}, len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            e = i
            while e + q < n and w[e] == w[e + q]:
                e += 1
            if e + q - i >= max(6, 4 * q):
                out.setdefault((i, e + q), q)  # a longer period of the same stretch comes later
            i = e + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def expected(i, text):
    w = planted(i, text or "")
    runs = brute(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    milli = 1000 * best[1] // best[2] if runs else None
    return len(runs), *best, milli, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(x for k, x in enumerate(w) if k not in gone))


def texts(seed):
    rng = random.Random(seed)
    out = [None, "", " \n", "a", "a " * 5, "a " * 6, "a b " * 150, "a b a " * 90, "a a b " * 31 + "a a c a a c a a c a a c", "x " + "a b c d e f g " * 40 + "y"]
    fib = ["a", "a b"]
    while len(fib[-1].split()) < 300:
        fib.append(f"{fib[-1]} {fib[-2]}")
    out.append(fib[-1])
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            unit = [rng.choice("abcde"[: rng.randint(1, 5)]) for _ in range(rng.choice([1, 2, 3, 5, 8, 17, 40]))]
            stretch = (unit * 12)[: rng.randint(0, len(unit) * 9)]
            parts += stretch + [rng.choice("abé") for _ in range(rng.randint(0, 30))]
        out.append(rng.choice([" ", "\n"]).join(parts))
    return out


@pytest.mark.parametrize("pairs", [1 << 20, 50])
def test_equals_scan(spark, monkeypatch, pairs):
    monkeypatch.setattr(periodic, "PAIRS", pairs)
    data = texts(1 if pairs > 50 else 2)
    d = spark.createDataFrame(list(enumerate(data)), DOC).repartition(3)
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r["doc_id"]: tuple(r[c] for c in names) for r in periodic.periodic_query(d).collect()}
    assert len(got) == len(data)
    for i, t in enumerate(data):
        assert got[i] == expected(i, t), (i, t)
    assert sum(g[0] > 0 for g in got.values()) > 60


def test_fragments_of_long_texts_are_stitched():
    """Runs over many tiles, solved in one call, against the scan."""
    rng = random.Random(5)
    for q in (1, 2, 7, 64, 100):
        unit = [f"w{rng.randrange(99)}" for _ in range(q)]
        w = [f"v{k}" for k in range(37)] + (unit * (1200 // q + 5))[: 1100 + q] + [f"u{k}" for k in range(20)]
        raw = " ".join(w).encode()
        _, period, s, e, _ = periodic.fragments(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert {(int(s[period == p].min()), int(e[period == p].max() - s[period == p].min()), int(p)) for p in set(period)} == set(brute(w))


def test_odd_input(spark):
    rows = [(1, None), (1, None), (None, "b b b b b b c"), (None, "b b b b b b c"), (2, ""), (3, "go " * 50_000), (3, "go " * 50_000), (3, "no run here")]
    d = spark.createDataFrame(rows, DOC).withColumn("RUNS", F.lit("x")).withColumn("_key", F.lit("own")).withColumn("period", F.lit(7))
    out = periodic.collapse_runs(d)
    got = out.collect()
    assert out.columns == ["doc_id", "_key", "period", *periodic.ADDED] and len(got) == 8 and all(r["_key"] == "own" and r["period"] == 7 for r in got)
    assert sorted((r["doc_id"] or 0, r["n_runs"], r["n_dropped"], r["collapsed"]) for r in got) == [(0, 1, 5, "b c")] * 2 + [(1, 0, 0, "")] * 2 + [(2, 0, 0, ""), (3, 0, 0, "no run here")] + [(3, 1, 49_999, "go")] * 2
    assert periodic.periodic_query(d.limit(0)).collect() == []
    assert periodic.periodic_query(d).count() == 8
