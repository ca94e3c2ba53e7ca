import numpy as np

from spark_rca.operators import causality as cz


def test_four_common_causes_part_two_effects(spark):
    """x and y are sums of the same four causes, so only the set of all four separates them."""
    z = 4
    load = np.concatenate([np.eye(z), np.ones((2, z))])
    cov = load @ load.T + np.diag([0.0] * z + [1.0, 1.0])
    corr = cov / np.sqrt(np.outer(cov.diagonal(), cov.diagonal()))
    rows = [("m", i + 1, j + 1, float(corr[i, j])) for i in range(6) for j in range(6)]
    got = {(r["src"], r["dst"]) for r in cz.pc_graph(spark.createDataFrame(rows, "incident_id string, x int, y int, corr double"), 500, 0.01).collect()}
    assert (5, 6) not in got and {(i, e) for i in range(1, 5) for e in (5, 6)} <= got


def test_links_are_thinned_by_more_than_three_conditions(spark):
    """An effect of five causes at lag 1: their earlier causes at lag 2 are no links."""
    rng = np.random.default_rng(41)
    n, k = 1500, 5
    x = rng.normal(size=(k + 1, n))
    for t in range(1, n):
        x[:k, t] += 0.6 * x[:k, t - 1]
        x[k, t] += x[:k, t - 1].sum()
    rows = [("m", i + 1, t, float(v)) for i in range(k + 1) for t, v in enumerate(x[i])]
    got = {(r["effect"], r["parent"], r["tau"]) for r in cz.lagged_links(spark.createDataFrame(rows, "incident_id string, service_id int, t long, value double"), 2).collect()}
    assert {(k + 1, i, 1) for i in range(1, k + 1)} <= got and not {(k + 1, i, 2) for i in range(1, k + 1)} & got
