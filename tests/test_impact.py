"""Impacts by branch and bound, against the enumeration of all paths."""

import resource

import numpy as np
import pytest

from spark_rca.operators import graph as gr
from spark_rca.operators import impact as im


def edges(spark, rows):
    return spark.createDataFrame(rows, "incident_id string, src int, dst int, weight double")


def by_listing(logs, start, end, max_len):
    """The best mean over all simple paths that end well, listed one by one."""
    out, best = set(np.flatnonzero(logs[end] > -np.inf).tolist()), None
    stack = [([start], 0.0)]
    while stack:
        path, s = stack.pop()
        if len(path) > 1 and path[-1] == end and (not out or out & set(path)):
            best = max(s / (len(path) - 1), -np.inf if best is None else best)
        if path[-1] != end and len(path) < max_len:
            stack += [([*path, x], s + logs[path[-1], x]) for x in np.flatnonzero(logs[path[-1]] > -np.inf).tolist() if x not in path]
    return best


@pytest.mark.parametrize("seed", range(30))
def test_equals_the_enumeration(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 9)) if seed else 9
    w = np.where(rng.random((n, n)) < rng.choice([0.2, 0.4, 0.8, 1.0]), rng.choice([0.1, 0.5, 0.8, 1.0, 1.5], (n, n)) if seed % 2 else rng.random((n, n)), 0)
    with np.errstate(divide="ignore"):
        logs = np.log(w)
    for max_len in (2, 3, n):
        for c in range(n):
            for e in range(n):
                if c != e:
                    got, want = im.best_mean_path(logs, c, e, max_len), by_listing(logs, c, e, max_len)
                    assert (got is None) == (want is None), (max_len, c, e)
                    assert want is None or got[0] == pytest.approx(want, abs=1e-12)


def test_equals_the_paths_of_graphs_in_spark(spark):
    rng = np.random.default_rng(1)
    rows = [(f"g{g}", a, b, float(rng.uniform(0.1, 1))) for g in range(4) for a in range(1, 12) for b in range(1, 12) if rng.random() < (0.15, 0.2, 0.25, 0.3)[g]]
    rows += [("g0", 1, 2, 0.5), ("g0", 1, 2, 0.4), ("g0", 3, 4, 0.0), ("g1", 5, 6, None), ("loop", 1, 1, 0.9), ("one", 1, 2, 0.3)]
    d = edges(spark, rows)
    services = spark.createDataFrame([(i, s) for i in ("g0", "g1", "g2", "g3", "loop", "one") for s in range(1, 12)], "incident_id string, service_id int")
    for max_len in (None, 3):
        got = {(r["incident_id"], r["c"], r["e"]): r["impact"] for r in im.full_impact(im.best_impacts(d, max_len), services).collect()}
        want = {(r["incident_id"], r["c"], r["e"]): r["impact"] for r in gr.impact_matrix(gr.netmedic_paths(d, max_len), services).collect()}
        assert got == pytest.approx(want, abs=1e-12) and len(got) == 6 * 121


def test_an_empty_graph_has_no_impacts(spark):
    assert im.best_impacts(edges(spark, [])).collect() == []


def test_one_incident_fills_many_tasks(spark):
    d = edges(spark, [("m", a, b, 0.5) for a in range(1, 34) for b in range(1, 34) if a != b and abs(a - b) < 4])
    plan = im.best_impacts(d)._jdf.queryExecution().toString()
    assert "block" in plan
    assert im.best_impacts(d, 3).select("c").distinct().count() == 33


def test_dense_graph_of_33_in_bounded_memory():
    """All 33! paths would not fit anywhere; the search of a pair keeps one order of nodes for each node of its path."""
    rng = np.random.default_rng(1)
    logs = np.log(rng.uniform(0.05, 1, (33, 33)))
    np.fill_diagonal(logs, -np.inf)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for e in range(1, 12):
        mean, path = im.best_mean_path(logs, 0, e, 33)
        assert len(set(path)) == len(path) and path[0] == 0 and path[-1] == e
        assert mean == pytest.approx(sum(logs[a, b] for a, b in zip(path, path[1:])) / (len(path) - 1))
        assert mean >= logs[0, e]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 50_000
