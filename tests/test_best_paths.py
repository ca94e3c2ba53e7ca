"""Best-first search of paths against listing all of them."""

import random

import pytest

from spark_rca.operators import graph as gr
from spark_rca.operators import relate as rl

EDGE = "incident_id string, src int, dst int, weight double"


def graphs(spark, seed, values):
    rng = random.Random(seed)
    rows = [(f"g{g}", a, b, rng.choice(values) if values else rng.random()) for g in range(12) for a in range(7) for b in range(7) if a != b and rng.random() < (0.2 + 0.06 * g)]
    return spark.createDataFrame([r for r in rows if r[3] >= 0] + [("g0", 8, 9, 0.0)], EDGE)


@pytest.mark.parametrize("mean", ["arithmetic", "geometric", "harmonic"])
@pytest.mark.parametrize(("seed", "values", "max_len", "k", "reach_end"), [(1, None, 5, 5, True), (2, [0.5, 1.0], 4, 7, False), (3, [0.25, 0.5, 2.0], 6, 3, True), (4, [1.0], 4, 9, True)])
def test_equals_listing(spark, mean, seed, values, max_len, k, reach_end):
    e = graphs(spark, seed, values)
    entries = spark.createDataFrame([(f"g{g}", s) for g in range(12) for s in ((0, 3) if g % 3 == 0 else (1,))], "incident_id string, service_id int")
    every = gr.score_paths(gr.backtrace_paths(e, entries, max_len, reach_end), mean)
    want = sorted((r["incident_id"], r["pos"], r["entry"], r["path"], r["prob"]) for r in rl.top_paths(every, k, 0.3).collect())
    got = gr.best_paths(e, entries, max_len, k, mean, 0.3, reach_end)
    assert sorted((r["incident_id"], r["pos"], r["entry"], r["path"], r["prob"]) for r in got.where("NOT capped").collect()) == want


def test_a_dense_graph_is_not_listed():
    """60 nodes, all linked: 10^8 paths of six nodes, of which the search looks at few."""
    rng = random.Random(8)
    edges = {d: [(s, rng.random() ** 3) for s in range(60) if s != d] for d in range(60)}
    found = gr._search(edges, [0], 6, 10, "arithmetic", True)
    assert len(found) == 10 and all(len(p) == 6 for _, p, _ in found)
    assert min(sum(w) / 5 for _, _, w in found) > 0.85


def test_no_entry_and_no_edge(spark):
    e = spark.createDataFrame([("a", 1, 2, 0.5)], EDGE)
    entries = spark.createDataFrame([("b", 1), ("a", 1)], "incident_id string, service_id int")
    got = {(r["incident_id"], tuple(r["path"])) for r in gr.best_paths(e, entries, 3, 5).collect()}
    assert got == {("a", (1,)), ("b", (1,))} == {(r["incident_id"], tuple(r["path"])) for r in gr.backtrace_paths(e, entries, 3).collect()}
