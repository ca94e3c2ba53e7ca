"""Grid points that share a plan, against one diagnosis for each point."""

import numpy as np
import pytest

from spark_rca.operators import graph as gr
from spark_rca.operators import relate as rl
from spark_rca.operators import windows as wn
from spark_rca.plans import diagnose as dg
from spark_rca.plans.points import Points

GRID = {
    "monitor_rank": [{"rho": 0.2, "steps": 20}, {"rho": 0.9, "steps": 20}, {"rho": 0.2, "steps": 5}],
    "cloud_ranger": [{"beta": b, "rho": r, "steps": 10} for b in (0.1, 0.9) for r in (0.1, 0.8)],
    "netmedic": [{"bins": 20, "delta": x, "hist": (0, -40), "cur": (-40, None)} for x in (0.05, 0.5)],
    "tbac": [{}],
    "dynamic_causality": [{"bef": 100, "step": 25, "sig": s, "ratio": r} for s in (0.01, 0.2) for r in (0.3, 0.9)] + [{"bef": 100, "step": 25, "sig": 0.2, "adf": True}],
    "microcause": [{"tau_max": 2, "rho": r, "lam": v} for r in (0.2, 0.6) for v in (0.1, 0.9)],
}


@pytest.fixture(scope="module")
def case(spark):
    rng, rows = np.random.default_rng(3), []
    for inc in ("a", "b~1"):
        x = rng.normal(size=(5, 200))
        x[2, 1:] += 0.8 * x[4, :-1]
        x[1, 2:] += 0.9 * x[2, :-2]
        x[0, 1:] += 0.9 * x[1, :-1]
        x[:, 150:] += rng.normal(size=(5, 1)) * 2
        rows += [(inc, s + 1, t, float(10 + v)) for s in range(5) for t, v in enumerate(x[s])]
    d = spark.createDataFrame(rows, "incident_id string, service_id int, t long, value double")
    one = lambda s: spark.createDataFrame([("a", s), ("b~1", s)], "incident_id string, service_id int")
    edges = spark.createDataFrame([(i, a, b, 1.0) for i in ("a", "b~1") for a, b in ((1, 2), (2, 3), (3, 5), (1, 4), (4, 5), (2, 4), (2, 5), (3, 4))], "incident_id string, src int, dst int, weight double")
    return d, one(1), one(5), edges


def found(df):
    return {(r["incident_id"], r["service_id"]): (r["score"] if r["score"] is None else round(r["score"], 9), r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("method", GRID)
def test_points_rank_as_single_diagnoses(case, method):
    d, entries, _, edges = case
    plans = dg._plans(method, GRID[method])
    assert sum(len(names) for _, _, names in plans) == len(GRID[method])
    for early, late, names in plans:
        if len(late) < 2:
            continue
        points = Points(late)
        every = points.split(dg.diagnose(method, d, entries, edges, **early, points=points), names).collect()
        scores = []
        for point, name in zip(late, names, strict=True):
            got = {(r["incident_id"], r["service_id"]): (r["score"] if r["score"] is None else round(r["score"], 9), r["rank"]) for r in every if r["params_id"] == name}
            want = found(dg.diagnose(method, d, entries, edges, **(early | point)))
            assert got.keys() == want.keys()
            assert {k: v[0] for k, v in got.items()} == pytest.approx({k: v[0] for k, v in want.items()}, abs=1e-8)
            scores.append(tuple(sorted((k, v[0]) for k, v in got.items())))
        assert len(set(scores)) > 1


def test_plans_do_not_grow_with_late_points(case):
    assert len(dg._plans("cloud_ranger", [{"beta": b / 50, "rho": r / 50} for b in range(50) for r in range(50)])) == 1
    assert len(dg._plans("dynamic_causality", [{"sig": s, "ratio": r} for s in (0.1, 0.2) for r in (0.5, 0.6)])) == 1
    # The significance of stationarity tests and of stored tests is one for a plan.
    assert len(dg._plans("dynamic_causality", [{"sig": s, "ratio": r, "adf": True} for s in (0.1, 0.2) for r in (0.5, 0.6)])) == 2
    assert len(dg._plans("tbac", [{}])) == 1


def test_sweep_is_one_diagnosis_for_all_late_points(case, monkeypatch):
    d, entries, truth, edges = case
    calls, run = [], dg.diagnose
    monkeypatch.setattr(dg, "diagnose", lambda *a, **k: calls.append(a[0]) or run(*a, **k))
    grid = {m: GRID[m] for m in ("monitor_rank", "tbac")}
    rows = dg.sweep_params(d, entries, truth, edges, grid).collect()
    assert calls == ["monitor_rank", "monitor_rank", "tbac"]
    assert {(r["incident_id"], r["method"], r["params_id"]) for r in rows} == {(i, m, p) for i in ("a", "b~1") for m, p in (("monitor_rank", "rho=0.2,steps=20"), ("monitor_rank", "rho=0.9,steps=20"), ("monitor_rank", "rho=0.2,steps=5"), ("tbac", ""))}
    services = d.select("incident_id", "service_id").distinct()
    want = dg.evaluate(run("monitor_rank", d, entries, edges, rho=0.9, steps=20), truth, services).collect()
    assert {r["incident_id"]: r["acc"] for r in rows if r["params_id"] == "rho=0.9,steps=20"} == pytest.approx({r["incident_id"]: r["acc"] for r in want})


def test_thresholds_share_one_search(spark, case):
    d, entries, truth, _ = case
    rng = np.random.default_rng(1)
    strength = spark.createDataFrame([(i, a, b, float(rng.integers(0, 9))) for i in ("a", "b~1") for a in range(1, 6) for b in range(1, 6) if a != b], "incident_id string, src int, dst int, weight double")
    rows = dg.compare_thresholds(strength, d, entries, truth, [0.3, 0.9], [4.0]).collect()
    corr, services = rl.entry_correlation(d, entries), d.select("incident_id", "service_id").distinct()
    for name, kept in (("adaptive=0.3", wn.adaptive_threshold(strength, 0.3)), ("adaptive=0.9", wn.adaptive_threshold(strength, 0.9)), ("static=4.0", wn.static_threshold(strength, 4.0))):
        ranked = rl.rank_services(gr.ranknode(gr.best_paths(wn.normalize(kept, "dst"), entries, 4, 50), corr, 50, 1), ["incident_id"])
        want = {r["incident_id"]: r["acc"] for r in dg.evaluate(ranked, truth, services).collect()}
        assert {r["incident_id"]: r["acc"] for r in rows if r["params_id"] == name} == pytest.approx(want)
    with pytest.raises(ValueError, match="no threshold"):
        dg.compare_thresholds(strength, d, entries, truth, [], [])
