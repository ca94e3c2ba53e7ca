"""Relations that queries derive from the star-schema tables, in Spark and as one SQL prelude."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spark_rca.functions.scalars import path_mean
from spark_rca.operators import graph as gr
from spark_rca.operators import prepare as pp
from spark_rca.operators import relate as rl
from spark_rca.operators import windows as wn
from spark_rca.operators.causality import accept_intervals
from spark_rca.sources.metrics import metrics_from_events

T = 720


class Tables:
    """Fixtures over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def events(self) -> DataFrame:
        hours = F.floor(F.expr("(unix_micros(cast(cast(ts AS string) || ' UTC' AS timestamp)) - unix_micros(timestamp'2024-01-01 00:00:00 UTC')) / 3600000000"))
        e = self.read("events").select("event_id", "ts", "user_id", "event_type", "value", hours.cast("long").alias("t"))
        return e.withColumn("incident_id", F.concat(F.lit("i"), F.floor(F.col("user_id") / 36))).withColumn("service_id", (F.floor(F.col("user_id") / 3) % 12 + 1).cast("int"))

    def metrics(self) -> DataFrame:
        c = F.col
        return metrics_from_events(self.events(), c("incident_id"), c("service_id"), c("t"), c("value"))

    def filled(self) -> DataFrame:
        return pp.fill_zeros(self.metrics())

    def z(self) -> DataFrame:
        return pp.zscore(self.filled())

    def services(self) -> DataFrame:
        return self.metrics().select("incident_id", "service_id").distinct()

    def dense(self) -> DataFrame:
        """Five services, one per event type, in one incident."""
        e = self.events()
        names = e.select("event_type").distinct()
        from pyspark.sql import Window

        ids = names.withColumn("service_id", F.row_number().over(Window.orderBy("event_type")).cast("int"))
        d = e.drop("service_id").join(F.broadcast(ids), "event_type")
        return metrics_from_events(d, F.lit("d"), F.col("service_id"), F.col("t"), F.col("value"))

    def lengths(self) -> DataFrame:
        return self.metrics().groupBy("incident_id").agg((F.max("t") + 1).alias("n"))

    def intervals(self) -> DataFrame:
        i = F.col("event_id")
        d = self.events().select(
            "incident_id", (i % 12 + 1).cast("int").alias("x"), (F.floor(i / 12) % 12 + 1).cast("int").alias("y"), ((i * 7) % 700).alias("start"), ((i * 7) % 700 + 1 + i % 19).alias("end"),
            (i * 37 % 1000 / F.lit(1000.0)).alias("p_yx"), F.when(i % 11 != 0, i * 53 % 1000 / F.lit(1000.0)).alias("p_xy"), (i % 13 / F.lit(20.0)).alias("adf_y"), (i % 17 / F.lit(25.0)).alias("adf_x"),
        )
        return d.where("x <> y")

    def accepted(self) -> DataFrame:
        return accept_intervals(self.intervals(), 0.1).select("incident_id", "x", "y", "start", "end", "p_yx", "p_xy")

    def curves(self) -> DataFrame:
        return rl.overlay_intervals(self.accepted(), self.lengths())

    def nodes(self) -> DataFrame:
        return self.services()

    def strength(self) -> DataFrame:
        return rl.edge_strength(self.accepted(), rl.service_pairs(self.nodes()))

    def edges(self) -> DataFrame:
        return gr.transition_graph(self.strength(), 0.8)

    def entries(self) -> DataFrame:
        return self.services().where("service_id = 1")

    def paths(self) -> DataFrame:
        return gr.backtrace_paths(self.edges(), self.entries(), 4)

    def scored(self) -> DataFrame:
        return self.paths().withColumn("prob", path_mean(F.col("edge_probs"), "arithmetic"))

    def corr(self) -> DataFrame:
        return rl.entry_correlation(self.filled(), self.entries())

    def ranking(self) -> DataFrame:
        return rl.rank_services(self.corr().withColumn("score", F.round("corr", 9)).drop("corr"), ["incident_id"])

    def truth(self) -> DataFrame:
        return self.services().where("service_id IN (3, 5)")

    def results(self) -> DataFrame:
        i = F.col("event_id")
        d = self.events().select(
            F.col("event_type").alias("method"), (i % 3 * 100).alias("window_start"), ((F.floor(i / 3) % 4 + 1) * 200).alias("window_len"), F.format_string("p%09d", i).alias("params_id"), (i % 2).alias("pc_aggregate"), (i % 3).alias("pc_alpha"),
            (i * 29 % 101 / F.lit(100.0)).alias("acc"), F.array(*[(i * k % 11 / F.lit(10.0)) for k in range(1, 6)]).alias("prks"), F.col("value").alias("time"),
        )
        return d.withColumn("pr_avg", F.aggregate("prks", F.lit(0.0), lambda a, x: a + x) / 5)

    def parts(self) -> DataFrame:
        return pp.slice_history_current(self.filled(), (0, -60), (-60, None))

    def trips(self) -> DataFrame:
        e = self.events().select(F.col("user_id").alias("trip_key"), F.expr("unix_seconds(cast(cast(ts AS string) || ' UTC' AS timestamp))").alias("x"), "value")
        return e.groupBy("trip_key", "x").agg(F.max("value").alias("value"))

    def stds(self) -> DataFrame:
        return wn.rolling_std(self.z(), 50)


PRELUDE = """
WITH RECURSIVE
ev AS (SELECT *, 'i' || (user_id // 36) AS incident_id, ((user_id // 3) % 12 + 1)::INT AS service_id, date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts))::BIGINT AS t FROM events),
cells AS (SELECT incident_id, service_id, t, round(sum(value), 2) AS value FROM ev GROUP BY 1, 2, 3),
lengths AS (SELECT incident_id, max(t) + 1 AS n FROM cells GROUP BY 1),
services AS (SELECT DISTINCT incident_id, service_id FROM ev),
grid AS (SELECT incident_id, service_id, unnest(range(0, n))::BIGINT AS t FROM services JOIN lengths USING (incident_id)),
metrics AS (SELECT incident_id, service_id, t, coalesce(value, 0.0::DOUBLE) AS value FROM grid LEFT JOIN cells USING (incident_id, service_id, t)),
filled AS (SELECT incident_id, service_id, t, coalesce(last_value(nullif(value, 0) IGNORE NULLS) OVER (PARTITION BY incident_id, service_id ORDER BY t ROWS UNBOUNDED PRECEDING),
  first_value(nullif(value, 0) IGNORE NULLS) OVER (PARTITION BY incident_id, service_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0::DOUBLE) AS value FROM metrics),
zs AS (SELECT incident_id, service_id, t, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS value FROM filled WINDOW w AS (PARTITION BY incident_id, service_id)),
types AS (SELECT event_type, row_number() OVER (ORDER BY event_type)::INT AS service_id FROM (SELECT DISTINCT event_type FROM events)),
dcells AS (SELECT types.service_id, t, round(sum(value), 2) AS value FROM ev JOIN types USING (event_type) GROUP BY 1, 2),
dense AS (SELECT 'd' AS incident_id, service_id, t, coalesce(value, 0.0::DOUBLE) AS value FROM (SELECT service_id, unnest(range(0, (SELECT max(t) + 1 FROM dcells)))::BIGINT AS t FROM types) g LEFT JOIN dcells USING (service_id, t)),
intervals AS (SELECT * FROM (SELECT incident_id, (event_id % 12 + 1)::INT AS x, ((event_id // 12) % 12 + 1)::INT AS y, (event_id * 7) % 700 AS start, (event_id * 7) % 700 + 1 + event_id % 19 AS "end",
  (event_id * 37 % 1000) / 1000::DOUBLE AS p_yx, CASE WHEN event_id % 11 <> 0 THEN (event_id * 53 % 1000) / 1000::DOUBLE END AS p_xy, (event_id % 13) / 20::DOUBLE AS adf_y, (event_id % 17) / 25::DOUBLE AS adf_x FROM ev) WHERE x <> y),
accepted AS (SELECT incident_id, x, y, start, "end", p_yx, p_xy FROM intervals WHERE p_yx < 0.1 AND (p_xy IS NULL OR p_xy >= 0.1)),
curves AS (SELECT p.incident_id, p.x, p.y, p.t, count(a.start)::BIGINT AS cnt FROM
  (SELECT DISTINCT a.incident_id, x, y, unnest(range(0, n))::BIGINT AS t FROM (SELECT DISTINCT incident_id, x, y FROM accepted) a JOIN lengths USING (incident_id)) p
  LEFT JOIN accepted a ON a.incident_id = p.incident_id AND a.x = p.x AND a.y = p.y AND a.start <= p.t AND p.t < a."end" GROUP BY 1, 2, 3, 4),
nodes AS (SELECT * FROM services),
entries AS (SELECT * FROM services WHERE service_id = 1),
truth AS (SELECT * FROM services WHERE service_id IN (3, 5)),
pairs AS (SELECT a.incident_id, a.service_id AS x, b.service_id AS y FROM nodes a JOIN nodes b USING (incident_id) WHERE a.service_id <> b.service_id),
strength AS (SELECT p.incident_id, p.x AS src, p.y AS dst, coalesce(sum(a."end" - a.start), 0)::DOUBLE AS weight FROM pairs p LEFT JOIN accepted a ON a.incident_id = p.incident_id AND a.x = p.x AND a.y = p.y GROUP BY 1, 2, 3),
kept AS (SELECT incident_id, src, dst, weight FROM (SELECT *, max(weight) OVER (PARTITION BY incident_id, src) AS m FROM strength) WHERE weight > 0 AND weight >= 0.8 * m),
edges AS (SELECT incident_id, src, dst, weight / sum(weight) OVER (PARTITION BY incident_id, dst) AS weight FROM kept),
walk AS (
  SELECT incident_id, service_id AS entry, [service_id] AS path, []::DOUBLE[] AS probs FROM entries
  UNION ALL
  SELECT w.incident_id, w.entry, list_append(w.path, e.src), list_append(w.probs, e.weight) FROM walk w JOIN edges e ON e.incident_id = w.incident_id AND e.dst = w.path[-1]
  WHERE len(w.path) < 4 AND NOT list_contains(w.path, e.src)),
paths AS (SELECT w.* FROM walk w WHERE len(path) = 4 OR NOT EXISTS (SELECT 1 FROM edges e WHERE e.incident_id = w.incident_id AND e.dst = w.path[-1])),
scored AS (SELECT *, CASE WHEN len(probs) = 0 THEN 0.0::DOUBLE ELSE list_sum(probs) / len(probs) END AS prob FROM paths),
corr AS (SELECT m.incident_id, m.service_id, abs(corr(m.value, e.value)) AS corr FROM filled m JOIN (SELECT incident_id, t, value FROM filled WHERE service_id = 1) e USING (incident_id, t) GROUP BY 1, 2),
ranking AS (SELECT incident_id, service_id, score, row_number() OVER (PARTITION BY incident_id ORDER BY score DESC NULLS LAST, service_id)::INT AS rank FROM (SELECT incident_id, service_id, round(corr, 9) AS score FROM corr)),
results AS (SELECT event_type AS method, event_id % 3 * 100 AS window_start, ((event_id // 3) % 4 + 1) * 200 AS window_len, printf('p%09d', event_id) AS params_id, event_id % 2 AS pc_aggregate, event_id % 3 AS pc_alpha,
  (event_id * 29 % 101) / 100::DOUBLE AS acc, [(event_id * k % 11) / 10::DOUBLE for k in [1, 2, 3, 4, 5]] AS prks, value AS time FROM ev),
res AS (SELECT *, list_sum(prks) / 5 AS pr_avg FROM results),
parts AS (SELECT m.*, CASE WHEN t < n - 60 THEN 'history' ELSE 'current' END AS part FROM filled m JOIN lengths USING (incident_id)),
trips AS (SELECT user_id AS trip_key, epoch(date_trunc('second', ts))::BIGINT AS x, max(value) AS value FROM events GROUP BY 1, 2),
stds AS (SELECT incident_id, service_id, t, value, CASE WHEN row_number() OVER o >= 50 AND lead(t) OVER o IS NOT NULL THEN stddev_pop(value) OVER (PARTITION BY incident_id, service_id ORDER BY t ROWS 49 PRECEDING) ELSE 0.0::DOUBLE END AS std FROM zs
  WINDOW o AS (PARTITION BY incident_id, service_id ORDER BY t))
"""
