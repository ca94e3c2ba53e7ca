import numpy as np

from spark_rca.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<double>"


def run(spark, x, **options):
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark, table, **options).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T >= 0.9
    label = np.arange(len(x))
    while (label != (new := np.array([label[r].min() for r in s]))).any():
        label = new
    assert [got[i]["n_links"] for i in range(len(x))] == (s.sum(1) - 1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == label.tolist()


def test_links_between_saturated_groups_are_found(spark):
    """Two tight groups of 40 whose only links are between pairs that both have 39 closer neighbours."""
    rng = np.random.default_rng(21)
    a, b = np.eye(16)[0], np.eye(16)[1]
    at = lambda deg: np.cos(np.radians(deg)) * a + np.sin(np.radians(deg)) * b
    x = np.concatenate([[at(t) for t in np.linspace(0, 4, 40)], [at(t) for t in np.linspace(29, 33, 40)], rng.normal(size=(60, 16))])
    run(spark, x)


def test_failing_recall_ends_in_all_products(spark, monkeypatch):
    rng = np.random.default_rng(22)
    x = rng.normal(size=(120, 16))
    x[60:] = x[:60] + 0.05 * rng.normal(size=(60, 16))
    lost = "u long, v long, s double"
    monkeypatch.setattr(embedding_dedup, "seed_pairs", lambda vectors, *a: vectors.sparkSession.createDataFrame([], lost))
    monkeypatch.setattr(embedding_dedup, "WIDE", 32)
    run(spark, x)


def test_rows_are_vectors_of_their_own(spark):
    """Ids repeat with other vectors and without one; lengths differ."""
    rows = [(1, [1.0, 0.0]), (1, None), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [1.0, 0.01]), (4, [1.0, 0.0, 0.0]), (5, [2.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(spark, spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", id string")).collect() if r["vec_id"] is not None)
    assert got == [(1, 0, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (3, 2, 1, False), (4, 1, 4, True), (5, 1, 4, False)]
    assert embedding_dedup.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA)).count() == 8


def test_a_hot_group_of_thousands_is_whole(spark):
    rng = np.random.default_rng(23)
    x = rng.normal(size=(2600, 16))
    x[200:] = x[0] + 0.1 * rng.normal(size=(2400, 16))
    run(spark, x)
