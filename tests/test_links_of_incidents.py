"""Lagged links of small incidents, a group each, beside those of large ones."""

import numpy as np
import pytest

from spark_rca.operators import causality as cz


@pytest.fixture(scope="module")
def metrics(spark):
    rng, rows = np.random.default_rng(8), []
    for inc, k in (("a", 6), ("b", 3), ("c", 1)):
        x = rng.normal(size=(k, 200))
        for i in range(1, k):
            x[i, 2:] += 0.8 * x[i - 1, :-2]
        rows += [(inc, 2 * i + 1, t, float(v)) for i in range(k) for t, v in enumerate(x[i])]
    return spark.createDataFrame(rows, "incident_id string, service_id int, t long, value double").cache()


def test_correlations_of_small_incidents_stay_in_their_groups(spark, metrics, monkeypatch):
    """What is written between the steps has a series' size, not that of all pairs of lags of all pairs of services."""
    written, cut = [], cz.cut
    monkeypatch.setattr(cz, "cut", lambda d: written.append(cut(d)) or written[-1])
    got = cz.lagged_links(metrics, 10)
    assert {(r["incident_id"], r["effect"], r["parent"], r["tau"]) for r in got.collect()} >= {("a", 3, 1, 2), ("b", 3, 1, 2), ("b", 5, 3, 2)}
    values = sum(len(v) for d in written for r in d.collect() for v in r if isinstance(v, list))
    assert 0 < values <= 10 * 200


def test_small_and_large_incidents_together(spark, metrics):
    """Incidents of up to ``block`` services are groups, the others are dealt by target; the links are the same."""
    one, mixed, dealt = ({(r["incident_id"], r["effect"], r["parent"], r["tau"]): r["p"] for r in cz.lagged_links(metrics, 3, 0.3, 0.1, block=b).collect()} for b in (16, 4, 1))
    assert set(one) == set(mixed) == set(dealt) and {k[0] for k in one} >= {"a", "b"}
    assert all(one[k] == pytest.approx(mixed[k], abs=1e-9) and one[k] == pytest.approx(dealt[k], abs=1e-9) for k in one)
