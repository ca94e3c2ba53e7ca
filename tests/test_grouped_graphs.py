"""Skeletons of small incidents in one group each, and interval tests of many short pairs in one stack."""

import numpy as np
import pytest

from spark_rca.functions import numeric as nm
from spark_rca.operators import causality as cz
from spark_rca.operators import relate as rl

METRIC = "incident_id string, service_id int, t long, value double"


@pytest.fixture(scope="module")
def metrics(spark):
    rng, rows = np.random.default_rng(21), []
    for inc, k, n in (("a", 9, 160), ("b", 6, 160), ("c", 2, 160), ("d", 3, 97)):
        x = rng.normal(size=(k, n))
        for i in range(1, k):
            x[i, 1:] += 0.7 * x[rng.integers(0, i), :-1]
            x[i] += 0.6 * x[rng.integers(0, i)]
        rows += [(inc, 3 * i + 2, t, float(v)) for i in range(k) for t, v in enumerate(x[i])]
    return spark.createDataFrame(rows, METRIC).cache()


def test_levels_of_small_incidents_are_no_jobs_of_their_own(spark, metrics, monkeypatch):
    """A table is written for each incident's whole skeleton, not for each level."""
    written, cut = [], cz.cut
    monkeypatch.setattr(cz, "cut", lambda d: written.append(d) or cut(d))
    assert cz.pc_graph(rl.pearson_matrix(metrics), 160, 0.1).count() > 0
    assert len(written) <= 2


def test_groups_and_levels_give_one_skeleton(spark, metrics):
    corr, got = cut_once(metrics), []
    for group, chunk in ((16, 4096), (6, 4096), (0, 3)):
        edges, seps = cz.pc_skeleton(corr, 160, 0.1, chunk=chunk, group=group)
        got.append(({tuple(r) for r in edges.select("incident_id", "src", "dst").collect()}, {(r["incident_id"], r["src"], r["dst"], tuple(r["cond"])) for r in seps.collect()}))
    assert got[0] == got[1] == got[2] and {e[0] for e in got[0][0]} >= {"a", "b"} and any(len(s[3]) > 1 for s in got[0][1])


def cut_once(metrics):
    return cz.cut(rl.pearson_matrix(metrics))


@pytest.mark.parametrize("stack", [1, 50, 4096])
def test_stacked_intervals_equal_pairs_alone(spark, metrics, monkeypatch, stack):
    monkeypatch.setattr(cz, "STACK", stack)
    some = metrics.where("incident_id IN ('c', 'd')")
    series = {(r["incident_id"], r["service_id"]): np.array(r["vals"]) for r in cz.pack(some).collect()}
    scaled = {k: (v - v.mean()) / v.std() for k, v in series.items()}
    got = {(r["incident_id"], r["x"], r["y"], r["start"], r["end"]): r for r in cz.granger_intervals(some, 30, 2, 0.1).collect()}
    want = {}
    for i, x in series:
        for j, y in series:
            if i == j and x != y:
                at = cz.splits(len(series[i, x]), 30)
                for a in range(len(at)):
                    for b in range(a + 1, len(at)):
                        s, e = np.array([at[a]]), np.array([at[b]])
                        if at[b] - at[a] >= 30:
                            want[i, x, y, at[a], at[b]] = tuple(float(nm.granger_p(nm.lag_rows(scaled[i, u], scaled[i, v], 2), s, e, 2)[0]) for u, v in ((y, x), (x, y)))
    assert set(got) == set(want) and len(want) > 60
    for k, (p, q) in want.items():
        r = got[k]
        assert r["p_yx"] == pytest.approx(p, abs=1e-12) and (r["p_xy"] is None) == (p >= 0.1) and r["accepted"] == (p < 0.1 and q >= 0.1)
        assert r["p_xy"] is None or r["p_xy"] == pytest.approx(q, abs=1e-12)
