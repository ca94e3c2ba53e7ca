"""Streams and appends against their batch twins, for any split, with late and repeated rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spark_rca.streaming.runs import EventJob, drain, read_sink
from spark_rca.streaming.spot import STATE, append_batch, append_spot, run_spot, stream_prepare, stream_spot, stream_trips

METRIC = "incident_id string, service_id int, t long, value double"
KINDS = [{"q": 1e-2, "level": 0.9}, {"q": 1e-2, "level": 0.9, "two_sided": True}, {"q": 1e-2, "depth": 5, "level": 0.9, "two_sided": True}, {"q": 1e-2, "level": 0.9, "adapt": True}]


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(11)
    rows = [("a", s, t, float(v)) for s in (1, 2) for t, v in enumerate(rng.normal(size=150) + (rng.random(150) > 0.96) * 6 * rng.choice([-1, 1], 150))]
    return spark.createDataFrame(rows + [("b", 1, t, float(t % 7)) for t in range(30)], METRIC).cache()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("kind", range(4))
def test_appends_equal_one_batch(spark, series, tmp_path, kind):
    want = rows(run_spot(series, n_init=60, **KINDS[kind]))
    got, at = [], 0
    for number, end in enumerate((40, 61, 62, 110, 150)):
        new = series.where(f"t >= {at} AND t < {end}")
        if number == 3:  # late, repeated and empty samples change nothing
            new = new.unionByName(series.where("t < 30").withColumn("value", F.lit(99.0))).unionByName(new).unionByName(new.limit(3).withColumn("value", F.lit(None).cast("double")))
        for _ in range(2 if number == 2 else 1):  # a try that is repeated
            out = rows(append_batch(spark, str(tmp_path / "s"), number, new, 60, **KINDS[kind]))
        got += out
        at = end
    assert sorted(got) == want and any(r[6] for r in want) == (kind != 3)


def test_series_without_news_keep_their_state(spark, series):
    state = spark.createDataFrame([], STATE)
    _, one = append_spot(state, series.where("t < 100"), 60, q=1e-2)
    _, two = append_spot(one, series.where("service_id = 2 AND t >= 100"), 60, q=1e-2)
    key = lambda d, s: [tuple(r) for r in d.where(f"incident_id = 'a' AND service_id = {s}").collect()]
    assert key(one, 1) == key(two, 1) and key(one, 2) != key(two, 2)
    assert len(two.where("incident_id = 'b'").first()["buffer"]) == 30 and two.where("incident_id = 'b'").first()["head"] is None


@pytest.mark.parametrize("kind", [1, 3])
def test_stream_equals_batch(spark, series, tmp_path, kind):
    source, job = str(tmp_path / "in"), str(tmp_path / "job")
    at = 0
    for end in (61, 62, 150):
        series.where(f"t >= {at} AND t < {end}").write.mode("append").parquet(source)
        if at == 62:
            series.where("t = 5").write.mode("append").parquet(source)  # late
        drain(stream_spot(spark.readStream.schema(series.schema).parquet(source), 60, **KINDS[kind]), job)
        at = end
    assert rows(read_sink(spark, job)) == rows(run_spot(series, n_init=60, **KINDS[kind]))


def test_state_written_by_a_batch_does_not_grow(spark, tmp_path):
    """Every sample is a peak: after 100 and after 1,100 peaks, a batch of one sample writes as much."""
    source, job, sizes = str(tmp_path / "in"), str(tmp_path / "job"), []
    d = spark.range(60).select(F.lit("a").alias("incident_id"), F.lit(1).alias("service_id"), F.col("id").alias("t"), (F.col("id") % 7).cast("double").alias("value"))
    more = lambda lo, hi: spark.range(lo, hi).select(F.lit("a").alias("incident_id"), F.lit(1).alias("service_id"), F.col("id").alias("t"), (7 + F.rand(1)).alias("value"))
    for part in (d.unionByName(more(60, 160)), more(160, 161), more(161, 1161), more(1161, 1162)):
        part.write.mode("append").parquet(source)
        before = {p: os.path.getsize(p) for p in deltas(job)}
        drain(stream_spot(spark.readStream.schema(d.schema).parquet(source), 60, q=1e-4, level=0.5, adapt=True), job)
        sizes.append(sum(os.path.getsize(p) for p in deltas(job) if p not in before))
    assert read_sink(spark, job).count() == 1102
    assert sizes[3] < 1.5 * sizes[1] + 4096


def deltas(job):
    return [os.path.join(d, f) for d, _, files in os.walk(f"{job}/checkpoint/state") for f in files if f.endswith((".changelog", ".delta", ".sst"))]


EVENT = "ts timestamp, k string, value double"


def events(spark, items):
    return spark.createDataFrame(items, "s string, k string, value double").select(F.to_timestamp("s").alias("ts"), "k", "value")


def test_buckets_of_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    first = events(spark, [("2024-01-01 00:10:00", "x", 1.0), ("2024-01-01 01:10:00", "x", 2.0), ("2024-01-01 05:00:00", "y", 4.0)])
    second = events(spark, [("2024-01-01 00:20:00", "x", 100.0), ("2024-01-01 04:30:00", "x", 8.0), ("2024-01-01 05:30:00", "y", 16.0)])
    first.coalesce(1).write.parquet(source)
    prep = lambda e: stream_prepare(e, "1 hour", "1 hour", F.lit("i"), F.col("k"))
    job = EventJob(spark, source, first.schema, str(tmp_path / "job"), prep)
    early = {(r["service_id"], r["start"].hour): r["value"] for r in job.run().collect()}
    assert early == {("x", 0): 1.0, ("x", 1): 2.0} and job.late == 0
    second.coalesce(1).write.mode("append").parquet(source)
    again = EventJob(spark, source, first.schema, str(tmp_path / "job"), prep)  # another process goes on
    again.run()
    got = {(r["service_id"], r["start"].hour): r["value"] for r in again.close().collect()}
    assert got == early | {("x", 4): 8.0, ("y", 5): 20.0} and again.late == 1


def test_trips_of_a_stream(spark, tmp_path):
    items = [(f"2024-01-0{d} {h:02}:{m:02}:00", k, 1.0) for d, h, m, k in ((1, 0, 0, "x"), (1, 0, 20, "x"), (1, 2, 0, "x"), (1, 0, 5, "y"), (2, 3, 0, "y"))]
    events(spark, items).write.parquet(str(tmp_path / "in"))
    job = EventJob(spark, str(tmp_path / "in"), events(spark, items).schema, str(tmp_path / "job"), lambda e: stream_trips(e, "30 minutes", "1 day", "k"))
    job.run()
    got = sorted((r["k"], r["start"].day, r["start"].hour, r["n"]) for r in job.close().collect())
    batch = stream_trips(events(spark, items), "30 minutes", "1 day", "k")
    assert got == [("x", 1, 0, 2), ("x", 1, 2, 1), ("y", 1, 0, 1), ("y", 2, 3, 1)] == sorted((r["k"], r["start"].day, r["start"].hour, r["n"]) for r in batch.collect())
