"""Walks as joins and as groups against dense matrices."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spark_rca.operators import graph as gr

EDGE = "incident_id string, src int, dst int, weight double"
ENTRY = "incident_id string, service_id int"


def graph(spark, seed):
    """Three incidents: with dead ends, a service that nothing reaches, and an edge of weight 0."""
    rng = random.Random(seed)
    raw = [(f"g{g}", a, b, rng.random()) for g in range(3) for a in range(6) for b in range(7) if rng.random() < 0.4] + [("g0", 8, 1, 0.0)]
    total = {}
    for i, a, _, w in raw:
        total[i, a] = total.get((i, a), 0) + w
    rows = [(i, a, b, w / total[i, a] if total[i, a] else 0.0) for i, a, b, w in raw]
    return rows, spark.createDataFrame(rows, EDGE), spark.createDataFrame([(f"g{g}", g) for g in range(3)] + [("none", 1)], ENTRY)


def dense(rows, entry, steps, jump=None):
    ids = sorted({x for _, a, b, _ in rows for x in (a, b)} | {entry} | set(jump or {}))
    p = np.zeros((len(ids), len(ids)))
    for _, a, b, w in rows:
        p[ids.index(a), ids.index(b)] += w
    j = np.array([(jump or {}).get(s, 0.0) for s in ids])
    v, total = np.zeros(len(ids)), np.zeros(len(ids))
    v[ids.index(entry)] = 1
    for _ in range(steps):
        lost = v[p.sum(1) == 0].sum()
        v = v @ p + (lost * j / j.sum() if j.sum() else 0)
        total += v
    return dict(zip(ids, total))


@pytest.mark.parametrize("limit", [1000, 8, 0])
@pytest.mark.parametrize("restart", [True, False])
def test_first_order(spark, limit, restart):
    rows, edges, entries = graph(spark, 3)
    jump = {s: 0.1 * s for s in range(8)}
    teleport = None if restart else spark.createDataFrame([(f"g{g}", s, w) for g in range(3) for s, w in jump.items()], "incident_id string, service_id int, weight double")
    got = {}
    for r in gr.expected_visits(edges, entries, 6, teleport, restart=restart, limit=limit).collect():
        got.setdefault(r["incident_id"], {})[r["service_id"]] = r["visits"]
    assert set(got) == {"g0", "g1", "g2"}
    for g in range(3):
        assert got[f"g{g}"] == pytest.approx(dense([r for r in rows if r[0] == f"g{g}"], g, 6, None if restart else jump))


@pytest.mark.parametrize("limit", [1000, 0])
def test_second_order(spark, limit):
    """States (prev, cur) as nodes of a dense walk; one incident has steps from (entry, entry), the other has not."""
    rng = random.Random(4)
    raw = [(i, p, c, n, rng.random()) for i in "ab" for p in range(4) for c in range(4) for n in range(4) if rng.random() < 0.5 and not (i == "b" and p == c == 0)] + [("a", 0, 0, 1, 0.3)]
    total = {}
    for i, p, c, _, w in raw:
        total[i, p, c] = total.get((i, p, c), 0) + w
    rows = [(i, p, c, n, w / total[i, p, c]) for i, p, c, n, w in raw]
    states = spark.createDataFrame(rows, "incident_id string, prev int, cur int, next int, prob double").groupBy("incident_id", "prev", "cur", "next").agg(F.sum("prob").alias("prob"))
    got = {}
    for r in gr.second_order_visits(states, spark.createDataFrame([("a", 0), ("b", 0)], ENTRY), 5, limit).collect():
        got.setdefault(r["incident_id"], {})[r["service_id"]] = r["visits"]
    for i in "ab":
        mine = [(p, c, n, w) for k, p, c, n, w in rows if k == i]
        v = {(0, 0): 1.0}
        if not any((p, c) == (0, 0) for p, c, _, _ in mine):
            first = sorted({c for p, c, _, _ in mine if p == 0})
            v = {(0, c): 1 / len(first) for c in first}
        want = {s: 0.0 for p, c, n, _ in mine for s in (c, n)} | {0: 0.0}
        for _ in range(5):
            nxt = {}
            for p, c, n, w in mine:
                nxt[c, n] = nxt.get((c, n), 0) + v.get((p, c), 0) * w
            v = nxt
            for (_, c), m in v.items():
                want[c] += m
        assert got[i] == pytest.approx(want)
