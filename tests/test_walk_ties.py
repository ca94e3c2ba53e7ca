"""Services that a walk visits alike are ranked by their number, whatever order their visits were added in."""

import pytest

from spark_rca.operators import graph as gr
from spark_rca.plans import diagnose as dg


@pytest.mark.parametrize("method, walk", [("cloud_ranger", "second_order_visits"), ("monitor_rank", "expected_visits")])
def test_visits_that_differ_in_their_last_bits_tie(spark, monkeypatch, method, walk):
    d = spark.createDataFrame([("a", s, t, float(1 + (s * t * t) % 7)) for s in (1, 2, 3) for t in range(20)], "incident_id string, service_id int, t long, value double")
    edges = spark.createDataFrame([("a", 1, 2, 1.0), ("a", 2, 3, 1.0), ("a", 3, 1, 1.0)], "incident_id string, src int, dst int, weight double")
    visits = spark.createDataFrame([("a", 1, 0.3), ("a", 2, 0.1 + 0.2), ("a", 3, 0.3 + 1e-6)], "incident_id string, service_id int, visits double")
    monkeypatch.setattr(gr, walk, lambda *_, **__: visits)
    got = {r["service_id"]: (r["rank"], r["score"]) for r in dg.diagnose(method, d, d.where("service_id = 1").select("incident_id", "service_id").distinct(), edges).collect()}
    assert got == {3: (1, 0.3 + 1e-6), 1: (2, 0.3), 2: (3, 0.1 + 0.2)}
