"""Whole diagnoses: evaluation, own graphs, reuse of interval tests, statistics per incident."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spark_rca.operators import causality as cz
from spark_rca.operators import relate as rl
from spark_rca.plans import diagnose as dg
from spark_rca.sources.metrics import has_intervals, load_intervals

METRIC = "incident_id string, service_id int, t long, value double"


@pytest.fixture(scope="module")
def planted(spark):
    """Two incidents of different length where 3 drives 2 and 2 drives the entry 1; 4 is noise."""
    rng, rows = np.random.default_rng(5), []
    for inc, n in (("a", 240), ("b", 360)):
        x = {3: rng.normal(size=n), 4: rng.normal(size=n)}
        for s, of, lag in ((2, 3, 2), (1, 2, 1)):
            x[s] = 0.2 * rng.normal(size=n)
            x[s][lag:] += 0.9 * x[of][:-lag]
        rows += [(inc, s, t, float(10 + v)) for s, series in x.items() for t, v in enumerate(series)]
    return spark.createDataFrame(rows, METRIC).cache()


def entries(spark):
    return spark.createDataFrame([("a", 1), ("b", 1)], "incident_id string, service_id int")


def truth(spark):
    return spark.createDataFrame([("a", 3), ("b", 3), ("b", 2)], "incident_id string, service_id int")


def test_f_and_p_equal_least_squares(spark, planted):
    got = {(r["x"], r["y"]): (r["f"], r["p"]) for r in cz.granger_f(cz.packed_pairs(planted.where("incident_id = 'a'")), 2).collect()}
    v = {s: np.array([r["value"] for r in planted.where(f"incident_id = 'a' AND service_id = {s}").orderBy("t").collect()]) for s in (1, 2, 3, 4)}
    for (x, y), (f, p) in got.items():
        own = np.column_stack([v[y][1:-1], v[y][:-2], np.ones(238)])
        both = np.column_stack([own, v[x][1:-1], v[x][:-2]])
        ssr = [((v[y][2:] - a @ np.linalg.lstsq(a, v[y][2:], rcond=None)[0]) ** 2).sum() for a in (own, both)]
        assert f == pytest.approx((ssr[0] - ssr[1]) / 2 / (ssr[1] / (238 - 5)), rel=1e-6) and 0 <= p <= 1
    assert got[3, 2][1] < 1e-6 < got[4, 2][1]


@pytest.mark.parametrize("method", sorted(dg.METHODS))
def test_methods_are_evaluated(spark, planted, method):
    edges = spark.createDataFrame([(i, s, d, 1.0) for i in "ab" for s, d in ((1, 2), (2, 3), (1, 4))], "incident_id string, src int, dst int, weight double")
    services = planted.select("incident_id", "service_id").distinct()
    params = {"bef": 200, "step": 40} if method == "dynamic_causality" else {"tau_max": 3} if method == "microcause" else {}
    rows = dg.evaluated(dg.diagnose(method, planted, entries(spark), edges, **params), truth(spark), services).collect()
    true = {"a": {3}, "b": {2, 3}}
    for inc in {r["incident_id"] for r in rows}:
        rank = {r["service_id"]: r["rank"] for r in rows if r["incident_id"] == inc}
        one = next(r for r in rows if r["incident_id"] == inc)
        want = [sum(rank.get(s, 99) <= k for s in true[inc]) / min(len(true[inc]), k) for k in range(1, 6)]
        assert one["prks"] == pytest.approx(want) and one["pr_avg"] == pytest.approx(np.mean(want))
        acc = np.mean([(4 - max(0, rank[s] - len(true[inc]))) / 4 if s in rank else 0 for s in true[inc]])
        assert one["acc"] == pytest.approx(acc)


def test_own_graph_links_what_drives(spark, planted):
    g = {(r["src"], r["dst"]) for r in dg.dependency_graph(planted).where("incident_id = 'a'").collect()}
    assert all((d, s) in g for s, d in g)
    ranked = dg.diagnose_monitor_rank(planted, entries(spark)).count()
    assert ranked > 0


def test_interval_tests_are_reused(spark, planted, tmp_path):
    store, key = str(tmp_path / "store"), dg.interval_key(200, 0, 40, 2, 0.1)
    assert not has_intervals(spark, store, key)
    one = dg.diagnose_dynamic_causality(planted, entries(spark), bef=200, step=40, store=store).collect()
    assert has_intervals(spark, store, key) and not has_intervals(spark, store, "other")
    size = load_intervals(spark, store, key).count()
    two = dg.diagnose_dynamic_causality(planted, entries(spark), bef=200, step=40, store=store).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and load_intervals(spark, store, key).count() == size


def test_chunks_follow_each_history(spark, planted):
    history = planted.withColumn("part", F.lit("history"))
    got = {r["incident_id"]: r["n"] for r in rl.chunk_means(history, size=100).groupBy("incident_id").agg(F.count_distinct("chunk").alias("n")).collect()}
    assert got == {"a": 2, "b": 3}
    raw = rl.chunk_samples(history, size=100).where("incident_id = 'b' AND service_id = 4").orderBy("chunk").collect()
    first = planted.where("incident_id = 'b' AND service_id = 4 AND t < 3").orderBy("t").collect()
    assert [r["mean"] for r in raw] == [r["value"] for r in first]


def test_sweep_gives_a_result_for_each_point(spark, planted):
    edges = spark.createDataFrame([(i, 1, 2, 1.0) for i in "ab"] + [(i, 2, 3, 1.0) for i in "ab"], "incident_id string, src int, dst int, weight double")
    grid = {"monitor_rank": [{"rho": 0.2, "steps": 5}, {"rho": 0.5, "steps": 5}], "tbac": [{}]}
    got = dg.sweep_windows(planted, entries(spark), truth(spark), edges, 120, [80], grid).collect()
    assert {(r["incident_id"], r["window_len"], r["method"], r["params_id"]) for r in got} == {(i, 80, m, p) for i in "ab" for m, p in (("monitor_rank", "rho=0.2,steps=5"), ("monitor_rank", "rho=0.5,steps=5"), ("tbac", ""))}
    best = dg.best_of_sweep(spark.createDataFrame(got)).collect()
    assert len(best) == len({(r["incident_id"], r["method"]) for r in got if r["acc"] > 0})
