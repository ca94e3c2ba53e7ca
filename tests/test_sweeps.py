"""Sweeps over windows with graphs of their own, against single diagnoses of a window."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spark_rca.operators import prepare as pp
from spark_rca.plans import diagnose as dg

METRIC = "incident_id string, service_id int, t long, value double"


def test_windows_with_own_graphs(spark):
    rng, rows = np.random.default_rng(5), []
    for inc in "ab":
        x = rng.normal(size=(4, 240))
        x[1, 2:] += 0.9 * x[2, :-2]
        x[0, 1:] += 0.9 * x[1, :-1]
        rows += [(inc, s + 1, t, float(10 + v)) for s in range(4) for t, v in enumerate(x[s])]
    d = spark.createDataFrame(rows, METRIC)
    entries = spark.createDataFrame([("a", 1), ("b", 1)], "incident_id string, service_id int")
    truth = spark.createDataFrame([("a", 3), ("b", 3)], "incident_id string, service_id int")
    grid = {"tbac": [{}], "dynamic_causality": [{"bef": 100, "step": 30}]}
    got = dg.sweep_windows(d, entries, truth, None, 120, [160], grid, [(1, 0.1), (4, 0.05)]).collect()
    assert {(r["incident_id"], r["method"], r["pc_aggregate"], r["pc_alpha"]) for r in got} == {(i, m, b, a) for i in "ab" for m, b, a in (("tbac", 1, 0.1), ("tbac", 4, 0.05), ("dynamic_causality", None, None))}
    assert all(r["window_start"] == 40 and r["window_len"] == 160 and r["time"] > 0 for r in got)
    # One window by hand: z-scores of the whole series, then the window, then its graph.
    w = dg.prepare(d).where("t >= 40 AND t < 200").withColumn("t", F.col("t") - 40)
    services = d.select("incident_id", "service_id").distinct()
    graph = dg.dependency_graph(w, 0.05, 4, prepared=True)
    want = dg.evaluate(dg.diagnose("tbac", w, entries, graph, prepared=True), truth, services).collect()
    assert {r["incident_id"]: r["acc"] for r in got if r["pc_aggregate"] == 4} == pytest.approx({r["incident_id"]: r["acc"] for r in want})
    reports = dg.sweep_reports(spark.createDataFrame(got))
    best = {r["method"]: r["acc_max"] for r in reports["top5"].collect()}
    assert best == {m: max(r["acc"] for r in got if r["method"] == m) for m in best} and reports["best_params"].count() > 0


def test_prepared_series_are_not_prepared_again(spark):
    """A z-score of 0 is a value."""
    d = spark.createDataFrame([("a", 1, t, v) for t, v in enumerate([1.0, 2.0, 3.0])], METRIC)
    p = dg.prepare(d)
    assert [r["value"] for r in dg.ready(p, True).orderBy("t").collect()] == [r["value"] for r in p.orderBy("t").collect()]
    assert p.where("value = 0").count() == 1 and pp.fill_zeros(p).where("value = 0").count() == 0
