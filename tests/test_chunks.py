"""Series operators over ranges of t against those over whole series."""

import random

import pytest
from pyspark.sql import functions as F

from spark_rca.operators import chunks as ch
from spark_rca.operators import prepare as pp
from spark_rca.operators import windows as wn

METRIC = "incident_id string, service_id int, t long, value double"


@pytest.fixture(scope="module")
def data(spark):
    """Series that start at different t, with long stretches of zeros at both ends and inside, one of zeros only, and a constant."""
    rng = random.Random(3)
    rows = []
    for s in range(6):
        v = [rng.choice([0, 0, rng.randint(1, 9)]) for _ in range(rng.randint(1, 60))]
        v = [0] * rng.randint(0, 25) + v + [0] * rng.randint(0, 25)
        rows += [("a", s, s * 3 + t, float(x)) for t, x in enumerate(v)]
    rows += [("a", 7, t, 0.0) for t in range(33)] + [("b", 1, t, 4.0) for t in range(21)]
    return spark.createDataFrame(rows, METRIC).cache()


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_equal_to_whole_series(data, chunk):
    assert rows(ch.fill_zeros(data, chunk)) == rows(pp.fill_zeros(data))
    for w in (1, 5, 20):
        assert rows(ch.rolling_mean(data, w, chunk)) == rows(wn.rolling_mean(data, w))
        assert rows(ch.rolling_std(data, w, chunk)) == rows(wn.rolling_std(data, w))
        assert rows(ch.back_mean(data, w, chunk)) == rows(wn.back_mean(data, w))


def test_scores(data):
    assert [r[:3] for r in rows(ch.zscore(data))] == [r[:3] for r in rows(pp.zscore(data))]
    both = ch.zscore(data).join(pp.zscore(data).withColumnRenamed("value", "w"), ["incident_id", "service_id", "t"])
    assert both.where("NOT (value <=> w) AND NOT abs(value - w) < 1e-9").count() == 0


def test_no_task_holds_a_series(spark):
    d = spark.range(10_000).select(F.lit("a").alias("incident_id"), F.lit(1).alias("service_id"), F.col("id").alias("t"), F.col("id").cast("double").alias("value"))
    most = ch._ranged(d, 500, 9).groupBy("incident_id", "service_id", "_c").count().agg(F.max("count")).first()[0]
    assert most == 509


def test_holes_are_refused(data):
    with pytest.raises(Exception, match="holes or repeated samples"):
        ch.rolling_mean(data.where("t <> 12"), 5, 7).collect()
