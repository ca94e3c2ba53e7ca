"""Series that start or end apart are compared by t; stored tests belong to their samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spark_rca.operators import causality as cz
from spark_rca.operators import relate as rl
from spark_rca.plans import diagnose as dg
from spark_rca.sources.metrics import load_intervals, missing_incidents, save_tests, series_digests

METRIC = "incident_id string, service_id int, t long, value double"


def frame(spark, series):
    """``series`` maps (incident, service) to (first t, values)."""
    return spark.createDataFrame([(i, s, t0 + k, float(x)) for (i, s), (t0, v) in series.items() for k, x in enumerate(v)], METRIC)


@pytest.fixture(scope="module")
def driven():
    """y follows x by two steps."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=300), 0.3 * rng.normal(size=300)
    y[2:] += x[:-2]
    return x, y


def test_intervals_of_the_shared_range(spark, driven):
    x, y = driven
    whole = frame(spark, {("a", 1): (20, x[20:280]), ("a", 2): (20, y[20:280])})
    ragged = frame(spark, {("a", 1): (0, x[:280]), ("a", 2): (20, y[20:])})
    key = lambda d: sorted(map(tuple, cz.granger_intervals(d, 40, 2).collect()))
    assert key(whole) == key(ragged)
    assert {(r["x"], r["y"]) for r in cz.granger_intervals(ragged, 40, 2).where("accepted").collect()} == {(1, 2)}
    f = lambda d: {(r["x"], r["y"]): r["f"] for r in cz.granger_f(cz.packed_pairs(d), 2).collect()}
    assert f(ragged) == pytest.approx(f(whole))


def test_correlation_of_shared_samples(spark, driven):
    x, y = driven
    z = np.full(100, 4.0)
    d = frame(spark, {("a", 1): (0, x[:280]), ("a", 2): (20, y[20:]), ("a", 3): (50, z), ("a", 4): (400, x), ("b", 1): (0, x)})
    holes = d.where("NOT (incident_id = 'a' AND service_id = 1 AND t IN (30, 31, 90))")
    keep = np.setdiff1d(np.arange(20, 280), [30, 31, 90])
    for data, t in ((d, np.arange(20, 280)), (holes, keep)):
        got = {(r["x"], r["y"]): r["corr"] for r in rl.pearson_matrix(data).where("incident_id = 'a'").collect()}
        assert got[1, 2] == got[2, 1] == pytest.approx(np.corrcoef(x[t], y[t])[0, 1], abs=1e-12)
        assert got[1, 3] is None and got[1, 4] is None and got[1, 1] == 0 and len(got) == 16


@pytest.mark.parametrize("block", [1, 2, 5, 64])
def test_blocks_do_not_matter(spark, block):
    rng = np.random.default_rng(8)
    series = {("a", s): (int(rng.integers(0, 9)), rng.normal(size=60) * 10**s + 1e6) for s in range(1, 8)}
    got = {(r["x"], r["y"]): r["corr"] for r in rl.pearson_matrix(frame(spark, series), zero_diag=False, block=block).collect()}
    for (x, y), c in got.items():
        (a, v), (b, w) = series["a", x], series["a", y]
        lo, hi = max(a, b), min(a, b) + 60
        assert c == pytest.approx(np.corrcoef(v[lo - a : hi - a], w[lo - b : hi - b])[0, 1], abs=1e-8)
    assert len(got) == 49


def test_holes_and_repeats_are_refused(spark, driven):
    x, y = driven
    d = frame(spark, {("a", 1): (0, x), ("a", 2): (0, y)})
    for bad in (d.where("NOT (service_id = 1 AND t = 7)"), d.unionByName(d.where("t = 7")), d.withColumn("t", F.when((F.col("t") == 7) & (F.col("service_id") == 2), 8).otherwise(F.col("t")))):
        with pytest.raises(Exception, match="holes or repeated samples"):
            cz.granger_intervals(bad, 40, 2).collect()


def test_store_keeps_data_sets_apart(spark, tmp_path):
    rng = np.random.default_rng(4)
    store = str(tmp_path / "store")

    def incident(name, gain):
        x, y, z = rng.normal(size=200), 0.3 * rng.normal(size=200), rng.normal(size=200)
        y[2:] += gain * x[:-2]
        return frame(spark, {(name, 1): (0, y + 9), (name, 2): (0, x + 9), (name, 3): (0, z + 9)})

    one, other, again = incident("a", 1.0), incident("b", 0.9), incident("a", -0.8)
    entry = lambda d: d.select("incident_id").distinct().withColumn("service_id", F.lit(1))
    run = lambda d, s: sorted(map(tuple, dg.diagnose_dynamic_causality(d, entry(d), bef=150, step=30, store=s).collect()))
    for d in (one, other, again, one.unionByName(other)):
        assert run(d, store) == run(d, None) != []
    key = dg.interval_key(150, 0, 30, 2, 0.1)
    rows = load_intervals(spark, store, key).count()
    assert run(one, store) == run(one, None) and load_intervals(spark, store, key).count() == rows
    # Other limits, tests or buckets are other parameters.
    assert len({key, dg.interval_key(150, 0, 30, 2, 0.1, min_len=60), dg.interval_key(150, 0, 30, 2, 0.1, adf=True), dg.interval_key(150, 0, 30, 2, 0.1, bucket=2)}) == 4


def test_a_save_that_is_tried_again_doubles_nothing(spark, tmp_path, driven):
    x, y = driven
    store = str(tmp_path / "store")
    d = frame(spark, {("a", 1): (0, x), ("a", 2): (0, y), ("c", 1): (0, x)})  # c has one service and no test
    incidents = series_digests(d)
    assert missing_incidents(spark, store, "k", incidents).count() == 2
    tests = cz.granger_intervals(d, 40, 2)
    for _ in range(2):
        save_tests(tests, incidents, store, "k")
    save_tests(tests.where("incident_id = 'a'"), incidents.where("incident_id = 'a'"), store, "k")  # another run at the same time
    assert load_intervals(spark, store, "k", incidents).count() == tests.count() > 0
    assert missing_incidents(spark, store, "k", incidents).count() == 0
    assert missing_incidents(spark, store, "k", series_digests(d.withColumn("value", F.col("value") + 1))).count() == 2
