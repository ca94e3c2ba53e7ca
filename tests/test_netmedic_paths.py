import pytest

from spark_rca.operators import graph as gr


def edges(spark, rows):
    return spark.createDataFrame([("m", *r) for r in rows], "incident_id string, src int, dst int, weight double")


def test_dense_graph_keeps_the_paths_of_all_starts(spark):
    n = 33
    paths = gr.netmedic_paths(edges(spark, [(i, j, 0.5) for i in range(1, n + 1) for j in range(1, n + 1) if i != j]), 3)
    per = {r["c"]: r["count"] for r in paths.groupBy("c").count().collect()}
    assert per == {s: (n - 1) + (n - 1) * (n - 2) for s in range(1, n + 1)}


def test_paths_have_no_length_limit(spark):
    paths = gr.netmedic_paths(edges(spark, [(i, i + 1, 0.5) for i in range(1, 6)]))
    services = spark.createDataFrame([("m", i) for i in range(1, 7)], "incident_id string, service_id int")
    got = {(r["c"], r["e"]): r["impact"] for r in gr.impact_matrix(paths, services).collect()}
    assert got[1, 6] == pytest.approx(0.5) and got[6, 1] == 0.01
