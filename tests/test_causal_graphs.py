"""Skeletons and lagged links dealt over tasks against one dense matrix in numpy."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spark_rca.functions.numeric import fisher_p, partial_corr
from spark_rca.operators import causality as cz
from spark_rca.operators import relate as rl
from spark_rca.operators.blocks import spread

METRIC = "incident_id string, service_id int, t long, value double"


def frame(spark, series):
    return spark.createDataFrame([(i, s, t0 + k, float(x)) for (i, s), (t0, v) in series.items() for k, x in enumerate(v)], METRIC)


def linear(rng, k, n, edges):
    """Series of k services where each depends on some of the earlier ones."""
    x = rng.normal(size=(k, n))
    for j in range(1, k):
        for i in rng.choice(j, size=min(j, edges), replace=False):
            x[j] += rng.uniform(0.4, 1.0) * x[i]
    return x


def skeleton(m, n, alpha):
    """(edges, first separating level) by scanning all subsets of one matrix."""
    k, level, sep = len(m), 0, {}
    adj = {i: set(range(k)) - {i} for i in range(k)}
    while any(len(a) > level for a in adj.values()):
        was = {i: set(a) for i, a in adj.items()}
        for i in range(k):
            for j in sorted(was[i]):
                if j in adj[i] and any(fisher_p(partial_corr(m, i, j, list(s)), n, level) > alpha for s in combinations(sorted(was[i] - {j}), level)):
                    adj[i].discard(j)
                    adj[j].discard(i)
                    sep[min(i, j), max(i, j)] = level
        level += 1
    return {(i, j) for i in adj for j in adj[i]}, sep


@pytest.mark.parametrize("chunk", [4096, 3])
def test_skeletons_of_ten_random_graphs(spark, chunk):
    rng = np.random.default_rng(12)
    data, want = {}, {}
    for g in range(10):
        x = linear(rng, int(rng.integers(4, 9)), 150, int(rng.integers(1, 4)))
        data |= {(f"g{g}", s): (0, v) for s, v in enumerate(x)}
        want[f"g{g}"] = skeleton(np.corrcoef(x), 150, 0.1), np.corrcoef(x)
    edges, seps = cz.pc_skeleton(rl.pearson_matrix(frame(spark, data)), 150, 0.1, chunk=chunk)
    got = {}
    for r in edges.collect():
        got.setdefault(r["incident_id"], set()).add((r["src"], r["dst"]))
    for g, ((e, sep), m) in want.items():
        assert got.get(g, set()) == e
        mine = {(r["src"], r["dst"]): r["cond"] for r in seps.where(f"incident_id = '{g}'").collect()}
        assert {k: len(c) for k, c in mine.items()} == sep
        assert all(fisher_p(partial_corr(m, i, j, c), 150, len(c)) > 0.1 for (i, j), c in mine.items())


def test_one_incident_of_200_services_fills_tasks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 400))
    x[1:] += 0.9 * x[:-1]  # a moving chain: neighbours correlate
    corr = rl.pearson_matrix(frame(spark, {("a", s): (0, v) for s, v in enumerate(x)}))
    edges, _ = cz.pc_skeleton(corr, 400, 1e-4)
    got = {(r["src"], r["dst"]) for r in edges.collect()}
    assert sum((s, s + 1) in got for s in range(199)) > 190 and len(got) < 2 * 260
    assert spread(corr, "incident_id", "x").select(F.spark_partition_id()).distinct().count() > 1  # as its tests are dealt


def links(x, ids, tau, pc_alpha, level):
    """Both steps over one dense matrix of all lags of all services."""
    n, k = x.shape[1] - 2 * tau, len(ids)
    c = np.corrcoef(np.concatenate([x[:, 2 * tau - t : x.shape[1] - t] for t in range(2 * tau + 1)]))
    parents, out = {}, {}
    for j in range(k):
        cand = sorted([t * k + i for t in range(1, tau + 1) for i in range(k)], key=lambda v: -abs(c[j, v]))
        for size in range(len(cand)):
            for v in list(cand):
                others = [u for u in cand if u != v][:size]
                if len(others) == size and len(cand) > size and fisher_p(partial_corr(c, j, v, others), n, size) > pc_alpha:
                    cand.remove(v)
        parents[j] = cand
    for j in range(k):
        for v in parents[j]:
            t, i = divmod(v, k)
            cond = [u for u in dict.fromkeys([u for u in parents[j] if u != v] + [u + t * k for u in parents[i]]) if u not in (j, v)]
            p = fisher_p(partial_corr(c, j, v, cond), n, len(cond))
            if p < level:
                out[ids[j], ids[i], t] = p
    return out


@pytest.mark.parametrize("block", [2, 16])
def test_links_equal_one_matrix(spark, block):
    rng = np.random.default_rng(6)
    ids = [3, 5, 8, 9, 12, 20]
    x = rng.normal(size=(6, 260))
    for t in range(3, 260):
        x[1, t] += 0.7 * x[0, t - 2]
        x[2, t] += 0.6 * x[1, t - 1] + 0.3 * x[2, t - 1]
        x[4, t] += 0.5 * x[2, t - 3]
    want = links(x, ids, 3, 0.2, 0.05)
    # Ragged ends and another incident do not matter; what all series share is x.
    pad = {s: (int(rng.integers(0, 9)), int(rng.integers(0, 9))) for s in ids}
    pad[3], pad[5] = (0, 4), (3, 0)
    series = {("a", s): (40 - pad[s][0], np.concatenate([rng.normal(size=pad[s][0]), v, rng.normal(size=pad[s][1])])) for s, v in zip(ids, x)}
    series |= {("b", s): (0, rng.normal(size=12)) for s in ids} | {("c", 1): (0, np.ones(80)), ("c", 2): (0, rng.normal(size=80))}
    got = {(r["effect"], r["parent"], r["tau"]): r["p"] for r in cz.lagged_links(frame(spark, series), 3, 0.2, 0.05, block=block).where("incident_id = 'a'").collect()}
    assert set(got) == set(want) >= {(5, 3, 2), (8, 5, 1), (12, 8, 3)}
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_lagged_blocks_are_dealt(spark):
    rng = np.random.default_rng(7)
    d = frame(spark, {("a", s): (0, rng.normal(size=60)) for s in range(40)})
    r = cz.lagged_correlations(d, 2, block=4)
    assert r.count() == 1600 and r.select(F.spark_partition_id()).distinct().count() > 1
    assert len(cz.block_pairs(d.select("incident_id", "service_id").distinct(), d, 4).select("_p", "_q").distinct().collect()) == 55
