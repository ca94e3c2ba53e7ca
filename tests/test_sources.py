"""Row numbers of matrices read from files, both directions of a reach, the error function."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spark_rca.functions.numeric import erf
from spark_rca.operators import graph as gr
from spark_rca.sources import metrics as io


def test_services_by_the_row_of_their_file(spark, tmp_path):
    """s10 is the second row, not the rank of its name; the file is read in many splits."""
    names = [f"s{i}" for i in (1, 10, 2, *range(200, 20, -1))]
    (tmp_path / "m.csv").write_text("".join(f"{n},{k}.5,{'' if k % 3 else k}\n" for k, n in enumerate(names, 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        d = io.read_metric_matrix(spark, str(tmp_path / "m.csv"), "csv", ["a", "b"], by_row=True)
        got = {(r["service_id"], r["t"]): r["value"] for r in d.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {}
    for k in range(1, len(names) + 1):
        want[k, 0], want[k, 1] = k + 0.5, 0.0 if k % 3 else float(k)
    assert got == want


def test_rows_of_an_empty_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text("")
    assert io.read_metric_matrix(spark, str(tmp_path / "m.csv"), "csv", ["a"], by_row=True).collect() == []


def test_both_directions_equal_each_alone(spark):
    rng = np.random.default_rng(2)
    rows = [(i, a, b, float(rng.random() < 0.9)) for i in "ab" for a in range(1, 9) for b in range(1, 9) if a != b and rng.random() < 0.2] + [("a", 1, 2, 1.0)] * 2
    d = spark.createDataFrame(rows, "incident_id string, src int, dst int, weight double")
    for both, way in zip(gr.reach_both(d), ("callers", "callees"), strict=True):
        one = {tuple(r) for r in gr.reach(d, way).collect()}
        assert {tuple(r) for r in both.collect()} == one and both.count() == len(one)
        # Breadth first by hand.
        a, b = (1, 2) if way == "callers" else (2, 1)
        for i in "ab":
            steps = {(r[a], r[b]) for r in rows if r[0] == i and r[3] > 0}
            for s in {x for r in rows if r[0] == i for x in r[1:3]}:
                depth, front, k = {s: 0}, {s}, 0
                while front:
                    k += 1
                    front = {y for x, y in steps if x in front and y not in depth}
                    depth |= {y: k for y in front}
                assert {(i, s, o, k) for o, k in depth.items() if k} == {r for r in one if r[:2] == (i, s)}


def test_error_function():
    x = np.concatenate([np.linspace(-7, 7, 2001), [0.0, 1e-300, 40.0, -40.0, np.inf, -np.inf]])
    assert erf(x) == pytest.approx([math.erf(v) for v in x], abs=1e-15, rel=1e-13)
    assert np.isnan(erf(np.array([np.nan]))).all() and erf(np.array([])).size == 0


def test_repeated_names_keep_their_rows(spark):
    wide = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 2)], "name string, v double, n int")
    got = io.melt_matrix(wide, "name", ["v"], row="n").select("service_id", "value").orderBy(F.col("service_id")).collect()
    assert [tuple(r) for r in got] == [(1, 1.0), (2, 2.0)]


def test_matrices_of_many_incidents_come_back(spark, tmp_path):
    rows = [("a", 1, 2, 0.1 + 0.2), ("a", 3, 1, 1 / 3), ("b", 2, 3, 2.5), ("b", 2, 1, 1e-9)]
    edges = spark.createDataFrame(rows, "incident_id string, src int, dst int, weight double")
    io.write_matrix(edges.repartition(3), [1, 2, 3], str(tmp_path / "m"))
    back = io.read_adjacency(spark, str(tmp_path / "m"), 3, ("incident_id",), header=True)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    (tmp_path / "one.csv").write_text("2,0,0,1.5\n1,,0.25,0\n")
    assert sorted(map(tuple, io.read_adjacency(spark, str(tmp_path / "one.csv"), 3).collect())) == [(1, 2, 0.25), (2, 3, 1.5)]
    (tmp_path / "none.csv").write_text("")
    assert io.read_adjacency(spark, str(tmp_path / "none.csv"), 3).count() == 0
