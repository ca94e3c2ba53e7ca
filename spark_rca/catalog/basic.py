"""Queries over sources, preparation, windows, joins, aggregates, rankings and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from spark_rca.catalog.fixtures import PRELUDE, Tables
from spark_rca.catalog.jobs import judged
from spark_rca.functions.scalars import abnormality, format_result, path_mean, scaled_diff, tail_quantile
from spark_rca.operators import causality as cz
from spark_rca.operators import chunks as ch
from spark_rca.operators import graph as gr
from spark_rca.operators import prepare as pp
from spark_rca.operators import relate as rl
from spark_rca.operators import windows as wn
from spark_rca.operators.impact import best_impacts, full_impact
from spark_rca.operators.lineage import cut, shared_folder
from spark_rca.sources import metrics as io
from spark_rca.streaming.runs import EventJob
from spark_rca.streaming.spot import stream_prepare, stream_trips

CATALOG: dict[str, tuple] = {}
KEY = ["incident_id", "service_id", "t"]
SERVICES = range(1, 13)
r6 = lambda c: F.round(c, 6)


def add(name: str, sql: str | None):
    def put(f):
        CATALOG[name] = (lambda spark, d: f(Tables(spark, d)), None if sql is None else PRELUDE + sql)
        return f

    return put


def v6(df, c="value"):
    return df.withColumn(c, r6(c))


# Sources and sinks
def month_matrix(x, name):
    """A row of twelve sums for each supplier, as matrix files have it."""
    months = range(1, 13)
    wide = x.read("lineitem").select(name.alias("name"), F.month("l_shipdate").alias("m"), "l_quantity").groupBy("name").pivot("m", list(months)).agg(F.sum("l_quantity").cast("double"))
    return wide.select("name", *[F.col(f"`{m}`").alias(f"m{m}") for m in months])


@add("io1_read_metric_matrix", """, g AS (SELECT l_suppkey, month(l_shipdate) AS m, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY 1, 2), n AS (SELECT DISTINCT l_suppkey FROM lineitem)
  SELECT 'm' AS incident_id, rank() OVER (PARTITION BY t ORDER BY name)::INT AS service_id, t, round(v, 6) AS value FROM
  (SELECT 's' || l_suppkey AS name, (m - 1)::BIGINT AS t, coalesce(v, 0.0::DOUBLE) AS v FROM (SELECT l_suppkey, unnest(range(1, 13)) AS m FROM n) LEFT JOIN g USING (l_suppkey, m))""")
def _(x):
    path = shared_folder(x.spark, "matrix")
    month_matrix(x, F.concat(F.lit("s"), F.col("l_suppkey"))).write.csv(path)
    return v6(io.read_metric_matrix(x.spark, path, "csv", [f"m{m}" for m in range(1, 13)]))


@add("io1_read_metric_matrix_by_row", """, g AS (SELECT l_suppkey, month(l_shipdate) AS m, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY 1, 2), n AS (SELECT DISTINCT l_suppkey FROM lineitem)
  SELECT 'm' AS incident_id, row_number() OVER (PARTITION BY m ORDER BY l_suppkey DESC)::INT AS service_id, (m - 1)::BIGINT AS t, round(coalesce(v, 0.0::DOUBLE), 6) AS value FROM (SELECT l_suppkey, unnest(range(1, 13)) AS m FROM n) LEFT JOIN g USING (l_suppkey, m)""")
def _(x):
    path = shared_folder(x.spark, "matrix")
    month_matrix(x, F.col("l_suppkey")).orderBy(F.desc("name")).withColumn("name", F.concat(F.lit("s"), F.col("name"))).write.parquet(path)
    return v6(io.read_metric_matrix(x.spark, path, "parquet", [f"m{m}" for m in range(1, 13)], by_row=True))


@add("io2_metrics_from_events", "SELECT * FROM metrics")
def _(x):
    return x.metrics()


@add("io3_read_adjacency", "SELECT incident_id, src, dst, round(weight, 6) AS weight FROM edges")
def _(x):
    path = shared_folder(x.spark, "adjacency")
    io.write_matrix(x.edges(), list(SERVICES), path)
    return v6(io.read_adjacency(x.spark, path, len(SERVICES), ("incident_id",), header=True), "weight")


@add("io4_edge_matrix", "SELECT incident_id, src, " + ", ".join(f"round(coalesce(max(CASE WHEN dst = {i} THEN weight END), 0.0::DOUBLE), 6) AS d{i}" for i in SERVICES) + " FROM edges GROUP BY 1, 2")
def _(x):
    m = io.edge_matrix(x.edges(), SERVICES)
    return m.select("incident_id", "src", *[r6(f"d{i}").alias(f"d{i}") for i in SERVICES])


@add("io6_append_results", "SELECT method, window_len, params_id, acc FROM res WHERE acc > 0")
def _(x):
    a, b = x.results().where("method = 'click'"), x.results().where("method <> 'click'")
    return io.append_results(a, b).select("method", "window_len", "params_id", "acc")


# Preparation
@add("p1_bucket_sum", "SELECT incident_id, service_id, t // 7 AS t, round(sum(value), 4) AS value FROM metrics JOIN lengths USING (incident_id) WHERE t // 7 < n // 7 GROUP BY 1, 2, 3")
def _(x):
    return pp.bucket_sum(x.metrics(), 7).withColumn("value", F.round("value", 4))


@add("p1_bucket_sum_compat", """SELECT incident_id, service_id, b AS t, round(sum(value), 4) AS value FROM (
  SELECT incident_id, service_id, t // 7 AS b, value FROM metrics JOIN lengths USING (incident_id) WHERE t // 7 > 0 AND t // 7 < n // 7
  UNION ALL SELECT incident_id, service_id, 0, value FROM metrics WHERE t BETWEEN 1 AND 7) GROUP BY 1, 2, 3""")
def _(x):
    return pp.bucket_sum(x.metrics(), 7, compat=True).withColumn("value", F.round("value", 4))


@add("p2_zero_counts", "SELECT incident_id, service_id, count(*) FILTER (value = 0) AS zeros FROM metrics GROUP BY 1, 2")
def _(x):
    return pp.zero_counts(x.metrics())


@add("p3_fill_zeros", "SELECT * FROM filled")
def _(x):
    return x.filled()


NEIGHBOURS = """, nb AS (SELECT incident_id, service_id, t, value, last_value(CASE WHEN value <> 0 THEN t END IGNORE NULLS) OVER a AS pt, last_value(nullif(value, 0) IGNORE NULLS) OVER a AS pv,
  first_value(CASE WHEN value <> 0 THEN t END IGNORE NULLS) OVER b AS nt, first_value(nullif(value, 0) IGNORE NULLS) OVER b AS nv FROM metrics
  WINDOW a AS (PARTITION BY incident_id, service_id ORDER BY t ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY incident_id, service_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@add("p4_fill_nearest", NEIGHBOURS + "SELECT incident_id, service_id, t, CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL THEN pv WHEN t - pt <= nt - t THEN pv ELSE nv END AS value FROM nb")
def _(x):
    return pp.fill_zeros(x.metrics(), "nearest")


@add("p4_fill_previous", NEIGHBOURS + "SELECT incident_id, service_id, t, pv AS value FROM nb")
def _(x):
    return pp.fill_zeros(x.metrics(), "previous")


@add("p4_fill_next", NEIGHBOURS + "SELECT incident_id, service_id, t, nv AS value FROM nb")
def _(x):
    return pp.fill_zeros(x.metrics(), "next")


@add("p4_fill_linear", NEIGHBOURS + """, k AS (SELECT incident_id, service_id, t, value, row_number() OVER (PARTITION BY incident_id, service_id ORDER BY t) AS i, row_number() OVER (PARTITION BY incident_id, service_id ORDER BY t DESC) AS j FROM metrics WHERE value <> 0),
  e AS (SELECT incident_id, service_id, max(t) FILTER (i = 1) AS t1, max(value) FILTER (i = 1) AS av, max(t) FILTER (i = 2) AS bt, max(value) FILTER (i = 2) AS bv, max(t) FILTER (j = 2) AS yt, max(value) FILTER (j = 2) AS yv, max(t) FILTER (j = 1) AS zt, max(value) FILTER (j = 1) AS zv FROM k GROUP BY 1, 2)
  SELECT incident_id, service_id, t, round(CASE WHEN bt IS NULL THEN coalesce(pv, nv, 0) WHEN pt IS NULL THEN av + (bv - av) * (t - t1) / (bt - t1) WHEN nt IS NULL THEN yv + (zv - yv) * (t - yt) / (zt - yt) WHEN pt = nt THEN pv ELSE pv + (nv - pv) * (t - pt) / (nt - pt) END, 6) AS value
  FROM nb LEFT JOIN e USING (incident_id, service_id)""")
def _(x):
    return v6(pp.fill_zeros(x.metrics(), "linear")).select(*KEY, "value")


@add("p6_zscore", "SELECT incident_id, service_id, t, round(value, 6) AS value FROM zs")
def _(x):
    return v6(x.z())


@add("p7_slice_incident", "SELECT m.* FROM metrics m JOIN lengths USING (incident_id) WHERE t >= greatest(400 - 100, 0) AND t < least(400 + 1000, n - 1)")
def _(x):
    starts = x.lengths().select("incident_id", F.lit(400).cast("long").alias("t"))
    return pp.slice_incident(x.metrics(), starts, 100, 1000).select(*KEY, "value")


@add("p8_centred_windows", """, w AS (SELECT incident_id, l AS window_len, greatest(0, 500 - l // 2) AS window_start, n FROM lengths, unnest([100, 600, 2000]) u(l))
  SELECT m.*, window_len::BIGINT AS window_len, window_start::BIGINT AS window_start FROM metrics m JOIN w USING (incident_id) WHERE t >= window_start AND t < least(window_start + window_len, n - 1)""")
def _(x):
    return pp.centred_windows(x.metrics(), 500, [100, 600, 2000]).select(*KEY, "value", "window_len", "window_start")


@add("p9_parse_datetime_parts", "SELECT o_orderkey, epoch(make_timestamp(year(o_orderdate), month(o_orderdate), day(o_orderdate), o_orderkey % 24, o_orderkey % 60, (o_orderkey % 60)::DOUBLE))::BIGINT AS s FROM orders")
def _(x):
    o = x.read("orders").select("o_orderkey", F.year("o_orderdate").alias("date_y"), F.month("o_orderdate").alias("date_m"), F.dayofmonth("o_orderdate").alias("date_d"), (F.col("o_orderkey") % 24).cast("int").alias("time_h"), (F.col("o_orderkey") % 60).cast("int").alias("time_m"), (F.col("o_orderkey") % 60).cast("int").alias("time_s"))
    d = pp.parse_datetime_parts(o)
    return d.select("o_orderkey", F.expr("unix_seconds(cast(cast(ts AS string) || ' UTC' AS timestamp))").alias("s"))


@add("p10_pick_date", "SELECT event_id FROM events WHERE day(ts) = 5")
def _(x):
    return pp.pick_date(x.read("events"), 5).select("event_id")


TRIPS = """, g AS (SELECT *, x - lag(x) OVER (PARTITION BY trip_key ORDER BY x) AS gap FROM trips),
  tr AS (SELECT *, (sum(CASE WHEN gap > 36000 THEN 1 ELSE 0 END) OVER (PARTITION BY trip_key ORDER BY x ROWS UNBOUNDED PRECEDING))::BIGINT AS trip FROM g)"""


@add("p11_split_trips", TRIPS + "SELECT trip_key, x, gap, trip FROM tr")
def _(x):
    return pp.split_trips(x.trips(), 36000).select("trip_key", "x", "gap", "trip")


@add("p12_pick_trip", TRIPS + "SELECT trip_key, x FROM (SELECT *, count(*) OVER (PARTITION BY trip_key, trip) AS n FROM tr) WHERE trip = 1 AND n >= 3")
def _(x):
    return pp.pick_trip(pp.split_trips(x.trips(), 36000), 1, 3).select("trip_key", "x")


@add("p13_resample_linear", TRIPS + """, lim AS (SELECT trip_key, trip, min(x) AS lo, max(x) AS hi FROM tr GROUP BY 1, 2), gr AS (SELECT trip_key, trip, unnest(range(lo, hi + 1, 1800)) AS x FROM lim),
  al AS (SELECT trip_key, trip, x, max(v) AS v, bool_or(g) AS g FROM (SELECT trip_key, trip, x, value AS v, false AS g FROM tr UNION ALL SELECT trip_key, trip, x, NULL, true FROM gr) GROUP BY 1, 2, 3),
  nn AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER a AS px, last_value(v IGNORE NULLS) OVER a AS pv, first_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER b AS nx, first_value(v IGNORE NULLS) OVER b AS nv FROM al
    WINDOW a AS (PARTITION BY trip_key, trip ORDER BY x ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY trip_key, trip ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT trip_key, trip, x, round(coalesce(v, pv + (nv - pv) * (x - px) / (nx - px)), 5) AS value FROM nn WHERE g""")
def _(x):
    return pp.resample_linear(pp.split_trips(x.trips(), 36000), 1800)


@add("p14_clean_names", "SELECT p_partkey, replace(replace(replace(p_name, 'a', ''), 'e', '3'), '3', 'E') AS name FROM part")
def _(x):
    return x.read("part").select("p_partkey", pp.clean_names(F.col("p_name"), [("a", ""), ("e", "3"), ("3", "E")]).alias("name"))


@add("p15_classify_services", "SELECT c_custkey, CASE WHEN contains(c_mktsegment, 'AUTO') THEN 'a' WHEN contains(c_mktsegment, 'U') THEN 'u' ELSE 'others' END AS kind FROM customer")
def _(x):
    return x.read("customer").select("c_custkey", pp.classify(F.col("c_mktsegment"), [("AUTO", "a"), ("U", "u")]).alias("kind"))


LAGS = """, pr AS (SELECT a.t, a.service_id AS x, b.service_id AS y, a.value AS vx, b.value AS vy FROM dense a JOIN dense b USING (t) WHERE a.service_id <> b.service_id),
  lg AS (SELECT 'd' AS incident_id, x, y, t, vy AS y0, lag(vy) OVER w AS y1, lag(vy, 2) OVER w AS y2, lag(vx) OVER w AS x1, lag(vx, 2) OVER w AS x2, row_number() OVER w AS i FROM pr WINDOW w AS (PARTITION BY x, y ORDER BY t))"""


@add("p16_lag_matrix", LAGS + "SELECT incident_id, x, y, t, y0, y1, y2, x1, x2 FROM lg WHERE i > 2")
def _(x):
    return pp.lag_matrix(rl.pair_series(x.dense()), 2)


@add("p17_segment_splits", "SELECT incident_id, seg::INT AS seg, (CASE WHEN seg = n // 70 THEN n ELSE seg * 70 END)::BIGINT AS pos FROM (SELECT incident_id, n, unnest(range(0, n // 70 + 1)) AS seg FROM lengths WHERE n // 70 > 0)")
def _(x):
    return pp.segment_splits(x.lengths(), 70)


@add("p18_candidate_intervals", """, s AS (SELECT incident_id, seg::INT AS seg, (CASE WHEN seg = n // 70 THEN n ELSE seg * 70 END)::BIGINT AS pos FROM (SELECT incident_id, n, unnest(range(0, n // 70 + 1)) AS seg FROM lengths))
  SELECT a.incident_id, a.seg AS seg_i, b.seg AS seg_j, a.pos AS start, b.pos AS "end" FROM s a JOIN s b USING (incident_id) WHERE a.seg < b.seg AND b.pos - a.pos BETWEEN 70 AND 400""")
def _(x):
    return pp.candidate_intervals(pp.segment_splits(x.lengths(), 70), 70, 400)


@add("p19_slice_history_current", "SELECT * FROM parts")
def _(x):
    return x.parts().select(*KEY, "value", "part")


# Joins
@add("j1_service_pairs", "SELECT a.incident_id, a.service_id AS x, b.service_id AS y FROM services a JOIN services b USING (incident_id) WHERE a.service_id <> b.service_id")
def _(x):
    return rl.service_pairs(x.services())


@add("j2_overlay_intervals", "SELECT * FROM curves")
def _(x):
    return x.curves()


@add("j3_param_grid", "SELECT p.method, b AS bef, a AS aft, concat_ws('-', p.method, b, a) AS params_id FROM (SELECT DISTINCT method FROM res) p, unnest([0, 100]) u(b), unnest([0, 200, 300]) v(a) WHERE b <> 0 OR a <> 0")
def _(x):
    grid = rl.param_grid(x.spark, "bef <> 0 OR aft <> 0", bef=[0, 100], aft=[0, 200, 300])
    m = x.results().select("method").distinct()
    return m.crossJoin(F.broadcast(grid)).select("method", "bef", "aft", F.concat_ws("-", "method", "bef", "aft").alias("params_id"))


TIMES = ", tm AS (SELECT window_start, window_len, pc_aggregate, pc_alpha, max(CASE WHEN window_len = 400 THEN -1 ELSE time END) AS pc_time FROM res WHERE pc_aggregate = 1 GROUP BY 1, 2, 3, 4)"


@add("j4_attach_graph_time", TIMES + "SELECT params_id, round(time + CASE WHEN pc_time > 0 THEN pc_time ELSE 0 END, 6) AS time FROM res LEFT JOIN tm USING (window_start, window_len, pc_aggregate, pc_alpha)")
def _(x):
    r = x.results()
    tm = r.where("pc_aggregate = 1").groupBy("window_start", "window_len", "pc_aggregate", "pc_alpha").agg(F.max(F.when(F.col("window_len") == 400, -1.0).otherwise(F.col("time"))).alias("pc_time"))
    return v6(rl.attach_graph_time(r, tm).select("params_id", "time"), "time")


@add("j5_mark_true", "SELECT r.*, t.service_id IS NOT NULL AS is_true FROM ranking r LEFT JOIN truth t USING (incident_id, service_id)")
def _(x):
    return rl.mark_true(x.ranking(), x.truth())


@add("j6_add_backward_edges", "SELECT incident_id, src, dst, round(weight, 6) AS weight FROM edges UNION ALL SELECT incident_id, dst, src, round(weight, 6) FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges f WHERE f.incident_id = e.incident_id AND f.src = e.dst AND f.dst = e.src)")
def _(x):
    return v6(rl.add_backward_edges(x.edges()), "weight")


@add("j7_second_order_states", "SELECT a.incident_id, a.src AS prev, a.dst AS cur, b.dst AS next, round(a.weight, 6) AS w1, round(b.weight, 6) AS w2 FROM edges a JOIN edges b ON a.incident_id = b.incident_id AND a.dst = b.src")
def _(x):
    return v6(v6(rl.second_order_states(x.edges()), "w1"), "w2")


@add("j8_graph_diff", "SELECT incident_id, src, dst, round(k.weight - s.weight / 2, 6) AS diff FROM kept k LEFT JOIN strength s USING (incident_id, src, dst)")
def _(x):
    s = x.strength()
    return v6(rl.graph_diff(wn.adaptive_threshold(s, 0.8), s.withColumn("weight", F.col("weight") / 2)), "diff")


PATH_EDGES = ", pe AS (SELECT DISTINCT incident_id, path[i + 1] AS src, path[i] AS dst FROM (SELECT incident_id, path, unnest(range(1, len(path))) AS i FROM paths))"


@add("j9_restrict_to_path_edges", PATH_EDGES + "SELECT incident_id, src, dst, round(weight, 6) AS weight FROM edges JOIN pe USING (incident_id, src, dst) WHERE round(weight, 9) > 0.3")
def _(x):
    e = x.edges().withColumn("weight", F.round("weight", 9))
    return v6(rl.restrict_to_path_edges(e, rl.path_edges(x.paths()), 0.3), "weight").select("incident_id", "src", "dst", "weight")


@add("j10_keep_valid_windows", "SELECT params_id FROM res WHERE (window_start, window_len) IN (SELECT DISTINCT window_start, window_len FROM res WHERE acc = 1)")
def _(x):
    r = x.results()
    return rl.keep_valid_windows(r, r.where("acc = 1").select("window_start", "window_len").distinct()).select("params_id")


# Aggregates
@add("a1_pearson_matrix", "SELECT a.incident_id, a.service_id AS x, b.service_id AS y, CASE WHEN a.service_id = b.service_id THEN 0.0::DOUBLE ELSE round(corr(a.value, b.value), 6) END AS corr FROM filled a JOIN filled b USING (incident_id, t) GROUP BY 1, 2, 3")
def _(x):
    return v6(rl.pearson_matrix(x.filled()), "corr")


@add("a2_entry_correlation", "SELECT incident_id, service_id, round(corr, 6) AS corr FROM corr")
def _(x):
    return v6(x.corr(), "corr")


@add("a3_edge_strength", "SELECT * FROM strength")
def _(x):
    return x.strength()


@add("a4_anomaly_score", "SELECT incident_id, t, count(*) FILTER (round(std, 9) > 1) AS score FROM stds GROUP BY 1, 2")
def _(x):
    return rl.anomaly_score(x.stds().withColumn("std", F.round("std", 9)))


@add("a5_path_node_counts", "SELECT incident_id, s AS service_id, count(*) AS cnt FROM (SELECT incident_id, entry, unnest(path[greatest(1, len(path) - 1):]) AS s FROM paths) WHERE s <> entry GROUP BY 1, 2")
def _(x):
    return rl.path_node_counts(x.paths(), 2)


@add("a6_eta_scores", """, th AS (SELECT *, avg(value) OVER (PARTITION BY incident_id, service_id) * 2 AS upper FROM metrics)
  SELECT incident_id, service_id, round(coalesce(max(CASE WHEN value > round(upper, 9) THEN abs(value - round(upper, 9)) / abs(round(upper, 9)) END), 0), 6) AS eta, coalesce(min(CASE WHEN value > round(upper, 9) THEN t END), 0) AS first_t FROM th GROUP BY 1, 2""")
def _(x):
    from pyspark.sql import Window

    d = x.metrics().withColumn("upper", F.round(F.avg("value").over(Window.partitionBy("incident_id", "service_id")) * 2, 9))
    return v6(rl.eta_scores(d), "eta")


@add("a7_history_stats", "SELECT incident_id, service_id, round(avg(value) FILTER (part = 'history'), 6) AS mean, round(stddev_pop(value) FILTER (part = 'history'), 6) AS std, round(avg(value) FILTER (part = 'current'), 6) AS cur, min(value) AS lo, max(value) AS hi FROM parts GROUP BY 1, 2")
def _(x):
    d = rl.history_stats(x.parts())
    return v6(v6(v6(d, "mean"), "std"), "cur")


CHUNKS = ", hh AS (SELECT incident_id, max(t) + 1 AS h FROM parts WHERE part = 'history' GROUP BY 1), ch AS (SELECT incident_id, service_id, ((h - 1 - t) // (h // 6))::INT AS chunk, avg(value) AS mean FROM parts JOIN hh USING (incident_id) WHERE part = 'history' AND (h - 1 - t) // (h // 6) < 6 GROUP BY 1, 2, 3)"


@add("a8_chunk_means", CHUNKS + "SELECT incident_id, service_id, chunk, round(mean, 6) AS mean FROM ch")
def _(x):
    return v6(rl.chunk_means(x.parts().where("part = 'history'"), 6), "mean")


@add("a9_covered_fraction", "SELECT incident_id, x, y, round(count(*) FILTER (cnt > 0) / count(*)::DOUBLE, 6) AS covered FROM curves GROUP BY 1, 2, 3")
def _(x):
    return v6(rl.covered_fraction(x.curves()), "covered")


@add("a10_power_mean", "SELECT method, round(sum((event_w) * sign(s) * pow(abs(s), 3)) / sum(event_w), 6) AS m3, round(sign(sum(event_w * sign(s) * pow(abs(s), 3)) / sum(event_w)) * pow(abs(sum(event_w * sign(s) * pow(abs(s), 3)) / sum(event_w)), 1.0::DOUBLE / 3), 6) AS mean FROM (SELECT method, window_len AS event_w, acc - 0.4::DOUBLE AS s FROM res) GROUP BY 1")
def _(x):
    d = x.results().select("method", F.col("window_len").alias("w"), (F.col("acc") - 0.4).alias("score"))
    m = rl.power_mean(d, ["method"], 3.0)
    cube = d.groupBy("method").agg(r6(F.sum(F.col("w") * F.signum("score") * F.pow(F.abs("score"), F.lit(3.0))) / F.sum("w")).alias("m3"))
    return v6(m, "mean").join(cube, "method")


@add("a11_average_rounds", "SELECT method, window_len, round(avg(pr_avg), 6) AS pr_avg, round(avg(acc), 6) AS acc, round(avg(prks[1]), 6) AS pr1, round(avg(prks[5]), 6) AS pr5 FROM res GROUP BY 1, 2")
def _(x):
    d = rl.average_rounds(x.results(), ["method", "window_len"])
    return d.select("method", "window_len", r6("pr_avg").alias("pr_avg"), r6("acc").alias("acc"), r6(F.get("prks", F.lit(0))).alias("pr1"), r6(F.get("prks", F.lit(4))).alias("pr5"))


@add("a12_max_by_length", "SELECT method, window_len, round(max(pr_avg), 6) AS pr_avg, max(acc) AS acc FROM res GROUP BY 1, 2")
def _(x):
    return v6(rl.max_by_length(x.results()), "pr_avg")


@add("a13_runtime_by_length", "SELECT method, window_len, round(avg(time), 6) AS time FROM res WHERE window_start = 0 GROUP BY 1, 2")
def _(x):
    return v6(rl.runtime_by_length(x.results()), "time")


@add("a14_best_params", "SELECT window_start, window_len, params_id, acc FROM (SELECT *, row_number() OVER (PARTITION BY window_start, window_len ORDER BY acc DESC, params_id) AS r FROM res) WHERE r = 1")
def _(x):
    return rl.best_params(x.results(), ["window_start", "window_len"]).select("window_start", "window_len", "params_id", "acc")


@add("a15_mean_by_significance", "SELECT method, pc_alpha, round(avg(pr_avg), 6) AS pr_avg, round(avg(acc), 6) AS acc FROM res GROUP BY 1, 2")
def _(x):
    return v6(v6(rl.mean_by_significance(x.results(), ["method", "pc_alpha"]), "pr_avg"), "acc")


@add("a15_sweep_summary_cube", "SELECT method, window_len, max(acc) AS max_acc, round(avg(acc), 6) AS avg_acc, count(*) AS n FROM res GROUP BY CUBE (method, window_len)")
def _(x):
    return v6(rl.sweep_summary(x.results()), "avg_acc")


@add("a16_global_impact", ", ab AS (SELECT incident_id, service_id, corr AS abnormality FROM corr) SELECT s.incident_id, s.src AS service_id, round(sum(s.weight * a.abnormality), 4) AS impact FROM strength s JOIN ab a ON a.incident_id = s.incident_id AND a.service_id = s.dst GROUP BY 1, 2")
def _(x):
    imp = x.strength().select("incident_id", F.col("src").alias("c"), F.col("dst").alias("e"), F.col("weight").alias("impact"))
    return rl.global_impact(imp, x.corr().withColumnRenamed("corr", "abnormality")).withColumn("impact", F.round("impact", 4))


# Windows
@add("w1_rolling_mean", "SELECT incident_id, service_id, t, round(CASE WHEN row_number() OVER o >= 24 THEN avg(value) OVER (PARTITION BY incident_id, service_id ORDER BY t ROWS 23 PRECEDING) ELSE 0 END, 6) AS mean FROM filled WINDOW o AS (PARTITION BY incident_id, service_id ORDER BY t)")
def _(x):
    return v6(wn.rolling_mean(x.filled(), 24), "mean").select(*KEY, "mean")


@add("w2_rolling_std", "SELECT incident_id, service_id, t, round(std, 6) AS std FROM stds")
def _(x):
    return v6(x.stds(), "std").select(*KEY, "std")


CHUNKED = {
    "w1_rolling_mean": lambda x: v6(ch.rolling_mean(x.filled(), 24, 50), "mean").select(*KEY, "mean"),
    "w2_rolling_std": lambda x: v6(ch.rolling_std(x.z(), 50, 50), "std").select(*KEY, "std"),
    "w3_back_mean": lambda x: v6(ch.back_mean(x.filled(), 10, 50), "mean"),
    "p3_fill_zeros": lambda x: ch.fill_zeros(x.metrics(), 50),
    "p6_zscore": lambda x: v6(ch.zscore(x.filled())),
}


@add("w3_back_mean", "SELECT incident_id, service_id, t, round(m, 6) AS mean FROM (SELECT *, avg(value) OVER (PARTITION BY incident_id, service_id ORDER BY t ROWS 9 PRECEDING) AS m FROM filled) WHERE t >= 9")
def _(x):
    return v6(wn.back_mean(x.filled(), 10), "mean")


@add("w4_normalize_by_row", "SELECT incident_id, src, dst, round(CASE WHEN s <> 0 THEN weight / s ELSE weight END, 6) AS weight FROM (SELECT *, sum(weight) OVER (PARTITION BY incident_id, src) AS s FROM strength)")
def _(x):
    return v6(wn.normalize(x.strength(), "src"), "weight")


@add("w5_adaptive_threshold", "SELECT * FROM kept")
def _(x):
    return wn.adaptive_threshold(x.strength(), 0.8)


@add("w5_static_threshold", "SELECT * FROM strength WHERE weight >= 200 AND weight > 0")
def _(x):
    return wn.static_threshold(x.strength(), 200)


@add("w6_instant_threshold", "SELECT incident_id, x AS src, y AS dst, cnt::DOUBLE AS weight FROM (SELECT *, max(cnt) OVER (PARTITION BY incident_id, x) AS m FROM curves WHERE t = 300) WHERE cnt > 0 AND cnt >= 0.6 * m")
def _(x):
    return wn.instant_threshold(x.curves(), 300, 0.6)


@add("w7_normalize_curves", "SELECT *, round(CASE WHEN max(cnt) OVER w > 0 THEN cnt / (max(cnt) OVER w)::DOUBLE ELSE 0 END, 6) AS level FROM curves WINDOW w AS (PARTITION BY incident_id, x, y)")
def _(x):
    return v6(wn.normalize_curves(x.curves()), "level")


ISLANDS = " SELECT incident_id, x, y, min(t) AS start, max(t) + 1 AS \"end\" FROM (SELECT *, t - row_number() OVER (PARTITION BY incident_id, x, y ORDER BY t) AS g FROM ins) GROUP BY incident_id, x, y, g"


@add("w8_islands_over", ", ins AS (SELECT * FROM curves WHERE cnt > 0)" + ISLANDS)
def _(x):
    return wn.islands_over(x.curves(), 0)


@add("w9_islands_at_max", ", ins AS (SELECT * FROM (SELECT *, max(cnt) OVER (PARTITION BY incident_id, x, y) AS m FROM curves) WHERE cnt = m AND m > 0)" + ISLANDS)
def _(x):
    return wn.islands_at_max(x.curves())


@add("w10_order_stat", "SELECT incident_id, service_id, value FROM (SELECT *, row_number() OVER (PARTITION BY incident_id, service_id ORDER BY value) AS i, count(*) OVER (PARTITION BY incident_id, service_id) AS n FROM metrics) WHERE i = least(floor(n * 0.98::DOUBLE), n - 1) + 1")
def _(x):
    return wn.order_stat(x.metrics(), 0.98)


# Rankings
@add("o1_anomaly_start", """, sc AS (SELECT incident_id, t, count(*) FILTER (round(std, 9) > 1) AS score FROM stds GROUP BY 1, 2), nn AS (SELECT incident_id, count(*) AS c FROM services GROUP BY 1)
  SELECT incident_id, t, score FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY score DESC, t DESC) AS r FROM sc JOIN nn USING (incident_id) WHERE score >= c * 0.0) WHERE r = 1""")
def _(x):
    return rl.anomaly_start(rl.anomaly_score(x.stds().withColumn("std", F.round("std", 9))), x.services())


@add("o2_order_intervals", 'SELECT incident_id, x, y, start, "end", row_number() OVER (PARTITION BY incident_id, x, y ORDER BY p_yx, p_xy DESC NULLS LAST, start, "end") AS pos FROM accepted')
def _(x):
    return rl.order_intervals(x.accepted()).select("incident_id", "x", "y", "start", "end", "pos")


TOP = """, sp AS (SELECT incident_id, entry, path, probs, round(prob, 9) AS prob FROM scored), tp AS (SELECT *, row_number() OVER w AS pos, coalesce(sum(CASE WHEN prob < 0.35 THEN 1 ELSE 0 END) OVER (PARTITION BY incident_id ORDER BY prob DESC, len(path), path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM sp WINDOW w AS (PARTITION BY incident_id ORDER BY prob DESC, len(path), path)),
  best AS (SELECT * FROM tp WHERE pos <= 20 AND u = 0)"""


@add("o3_top_paths", TOP + "SELECT incident_id, array_to_string(path, ',') AS path, round(prob, 6) AS prob, pos FROM best")
def _(x):
    d = rl.top_paths(x.scored().withColumn("prob", F.round("prob", 9)), 20, 0.35)
    return d.select("incident_id", F.concat_ws(",", F.transform("path", lambda p: p.cast("string"))).alias("path"), r6("prob").alias("prob"), "pos")


@add("o4_rank_services", "SELECT * FROM ranking")
def _(x):
    return x.ranking()


@add("o5_top5_summary", "SELECT method, window_start, window_len, round(avg(acc), 6) AS acc_mean, round(stddev_pop(acc), 6) AS acc_std, max(acc) AS acc_max, round(avg(time), 6) AS time_mean FROM (SELECT *, row_number() OVER (PARTITION BY method, window_start, window_len ORDER BY acc DESC, time, params_id) AS r FROM res) WHERE r <= 5 GROUP BY 1, 2, 3")
def _(x):
    return v6(v6(v6(rl.top5_summary(x.results()), "acc_mean"), "acc_std"), "time_mean")


# Sets
@add("x1_path_edges", PATH_EDGES + "SELECT * FROM pe")
def _(x):
    return rl.path_edges(x.paths())


@add("x2_compare_edges", """, f AS (SELECT incident_id, src, dst FROM edges), tr AS (SELECT incident_id, src, dst FROM strength WHERE weight >= 150)
  SELECT *, 'correct' AS kind FROM (SELECT * FROM f INTERSECT SELECT * FROM tr) UNION ALL SELECT *, 'missing' FROM (SELECT * FROM tr EXCEPT SELECT * FROM f) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM f EXCEPT SELECT * FROM tr)""")
def _(x):
    return rl.compare_edges(x.edges(), wn.static_threshold(x.strength(), 150))


@add("x3_confounders", """, pa AS (SELECT incident_id, dst AS s, src AS p FROM edges), nd AS (SELECT DISTINCT incident_id, s FROM (SELECT incident_id, src AS s FROM edges UNION ALL SELECT incident_id, dst FROM edges) WHERE s <> 1),
  al AS (SELECT nd.incident_id, nd.s, pa.p FROM nd JOIN pa ON pa.incident_id = nd.incident_id AND (pa.s = nd.s OR pa.s = 1))
  SELECT nd.incident_id, nd.s AS service_id, coalesce(string_agg(DISTINCT al.p::VARCHAR, ',' ORDER BY al.p::VARCHAR), '') AS cond FROM nd LEFT JOIN al ON al.incident_id = nd.incident_id AND al.s = nd.s AND al.p <> 1 AND al.p <> nd.s GROUP BY 1, 2""")
def _(x):
    d = rl.confounders(x.edges(), x.entries())
    return d.select("incident_id", "service_id", F.concat_ws(",", F.array_sort(F.transform("cond", lambda c: c.cast("string")))).alias("cond"))


@add("x4_result_labels", "SELECT DISTINCT window_start, window_len FROM res WHERE method = 'click'")
def _(x):
    return rl.result_labels(x.results(), "click")


# Scalars
@add("f1_f3_path_means", """SELECT incident_id, array_to_string(path, ',') AS path, round(prob, 6) AS arithmetic,
  round(exp(list_sum([ln(p) for p in probs if p <> 1]) / nullif(len([p for p in probs if p <> 1]), 0)), 6) AS geometric,
  round(nullif(len([p for p in probs if p <> 1]), 0) / list_sum([1 / p for p in probs if p <> 1]), 6) AS harmonic FROM scored""")
def _(x):
    p = F.col("edge_probs")
    return x.paths().select("incident_id", F.concat_ws(",", F.transform("path", lambda s: s.cast("string"))).alias("path"), *[r6(path_mean(p, m)).alias(m) for m in ("arithmetic", "geometric", "harmonic")])


ABNORMALITY = """, hs AS (SELECT incident_id, service_id, avg(value) FILTER (part = 'history') AS mean, stddev_pop(value) FILTER (part = 'history') AS std, avg(value) FILTER (part = 'current') AS cur FROM parts GROUP BY 1, 2),
  hx AS (SELECT incident_id, service_id, abs(cur - mean) / (CASE WHEN std > 0 THEN std END * sqrt(2)) AS v FROM hs),
  am AS (SELECT incident_id, service_id, CASE WHEN v = 0 THEN 0 WHEN v >= 6 THEN 1 ELSE 2 / sqrt(pi()) * exp(-v * v) * list_sum([exp((2 * k + 1) * ln(v) + 2 * k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2)) for k in range(0, 160)]) END::DOUBLE AS abnormality FROM hx)"""


@add("f4_abnormality", ABNORMALITY + " SELECT incident_id, service_id, round(abnormality, 6) AS abnormality FROM am")
def _(x):
    d = rl.history_stats(x.parts())
    return d.select("incident_id", "service_id", r6(abnormality(F.col("cur"), F.col("mean"), F.col("std"))).alias("abnormality"))


@add("f5_scaled_diff", "SELECT p_partkey, round(abs(p_retailprice - 1000) / (h - l), 6) AS d FROM part, (SELECT min(p_retailprice) AS l, max(p_retailprice) AS h FROM part)")
def _(x):
    p = x.read("part")
    return p.crossJoin(p.agg(F.min("p_retailprice").alias("l"), F.max("p_retailprice").alias("h"))).select("p_partkey", r6(scaled_diff(F.col("p_retailprice"), F.lit(1000.0), F.col("l"), F.col("h"))).alias("d"))


@add("f6_format_result", "SELECT params_id, printf('%.4f\t%.4f\t%.4f\t%.4f\t%.4f\t%.4f\t%.4f', prks[1], prks[2], prks[3], prks[4], prks[5], round(pr_avg, 4), acc) AS excel FROM res".replace("\t", "\\t").replace("printf('", "printf(E'"))
def _(x):
    r = x.results()
    return r.select("params_id", format_result(F.col("prks"), F.col("acc")).alias("excel"))


@add("t6_tail_quantile", "SELECT params_id, round(CASE WHEN pc_alpha = 0 THEN time - acc * ln(r) ELSE time + acc / pc_alpha * (pow(r, -pc_alpha) - 1) END, 6) AS z FROM (SELECT *, window_len * 0.001::DOUBLE / 20 AS r FROM res)")
def _(x):
    c = F.col
    return x.results().select("params_id", r6(tail_quantile(0.001, c("window_len"), F.lit(20), c("time"), c("pc_alpha").cast("double"), c("acc"))).alias("z"))


# Evaluation
EVAL = ", nt AS (SELECT incident_id, count(*) AS n FROM truth GROUP BY 1), mk AS (SELECT r.incident_id, r.rank, t.service_id IS NOT NULL AS hit FROM ranking r LEFT JOIN truth t USING (incident_id, service_id))"


@add("e1_precision_at_k", EVAL + "SELECT incident_id, round(count(*) FILTER (hit AND rank <= 3) / least(any_value(n), 3)::DOUBLE, 6) AS pr FROM mk JOIN nt USING (incident_id) GROUP BY 1")
def _(x):
    return v6(rl.precision_at_k(x.ranking(), x.truth(), 3), "pr")


@add("e2_pr_stat", EVAL + "SELECT incident_id, round((" + " + ".join(f"count(*) FILTER (hit AND rank <= {k}) / least(any_value(n), {k})::DOUBLE" for k in range(1, 6)) + ") / 5, 6) AS pr_avg, round(count(*) FILTER (hit AND rank <= 5) / least(any_value(n), 5)::DOUBLE, 6) AS pr5 FROM mk JOIN nt USING (incident_id) GROUP BY 1")
def _(x):
    return rl.pr_stat(x.ranking(), x.truth()).select("incident_id", r6("pr_avg").alias("pr_avg"), r6(F.get("prks", F.lit(4))).alias("pr5"))


@add("e3_rank_score", EVAL + "SELECT t.incident_id, round(avg(CASE WHEN r.rank IS NULL THEN 0 ELSE (12 - greatest(0, r.rank - n)) / 12::DOUBLE END), 6) AS acc FROM truth t JOIN nt USING (incident_id) LEFT JOIN ranking r USING (incident_id, service_id) GROUP BY 1")
def _(x):
    return v6(rl.rank_score(x.ranking(), x.truth(), 12), "acc")


# Causality with closed forms
@add("g1_granger_lag1", LAGS + """, cv AS (SELECT x, y, covar_pop(y0, y0) AS syy, covar_pop(y1, y1) AS saa, covar_pop(x1, x1) AS sbb, covar_pop(y1, x1) AS sab, covar_pop(y0, y1) AS sya, covar_pop(y0, x1) AS syb, count(*) AS n FROM lg WHERE i > 1 GROUP BY 1, 2)
  SELECT 'd' AS incident_id, x, y, round(((syy - sya * sya / saa) - u) / u * (n - 3), 4) AS f FROM (SELECT *, syy - (sya * sya * sbb - 2 * sya * syb * sab + syb * syb * saa) / (saa * sbb - sab * sab) AS u FROM cv)""")
def _(x):
    return cz.granger_lag1(pp.lag_matrix(rl.pair_series(x.dense()), 1)).withColumn("f", F.round("f", 4))


@add("g4_gate_stationary", 'SELECT incident_id, x, y, start, "end" FROM intervals WHERE p_yx < 0.2 AND (p_xy IS NULL OR p_xy >= 0.2) AND adf_y <= 0.2 AND adf_x <= 0.2')
def _(x):
    return cz.gate_stationary(x.intervals(), 0.2).select("incident_id", "x", "y", "start", "end")


@add("g5_accept_intervals", 'SELECT incident_id, x, y, start, "end" FROM accepted')
def _(x):
    return x.accepted().select("incident_id", "x", "y", "start", "end")


# Graph
@add("r1_transition_graph", "SELECT incident_id, src, dst, round(weight, 6) AS weight FROM edges")
def _(x):
    return v6(x.edges(), "weight")


@add("r2_backtrace_paths", "SELECT incident_id, entry, array_to_string(path, ',') AS path, round(list_sum(probs), 6) AS total FROM paths")
def _(x):
    return x.paths().select("incident_id", "entry", F.concat_ws(",", F.transform("path", lambda s: s.cast("string"))).alias("path"), r6(F.when(F.size("edge_probs") > 0, F.aggregate("edge_probs", F.lit(0.0), lambda a, p: a + p))).alias("total"))


@add("r3_score_paths", "SELECT incident_id, array_to_string(path, ',') AS path, round(nullif(len([p for p in probs if p <> 1]), 0) / list_sum([1 / p for p in probs if p <> 1]), 6) AS prob FROM paths")
def _(x):
    return gr.score_paths(x.paths()).select("incident_id", F.concat_ws(",", F.transform("path", lambda s: s.cast("string"))).alias("path"), r6("prob").alias("prob"))


@add("r2_best_paths", """, hp AS (SELECT *, nullif(len([p for p in probs if p <> 1]), 0) / list_sum([1 / p for p in probs if p <> 1]) AS prob FROM paths),
  rk AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY round(prob, 9) DESC NULLS LAST, len(path), path) AS pos FROM hp) SELECT incident_id, entry, round(prob, 6) AS prob, pos, FALSE AS capped FROM rk WHERE pos <= 20""")
def _(x):
    return v6(gr.best_paths(x.edges(), x.entries(), 4, 20), "prob").select("incident_id", "entry", "prob", F.col("pos").cast("long").alias("pos"), "capped")


@add("r4_ranknode", TOP + "SELECT c.incident_id, c.s AS service_id, round(c.cnt / 40::DOUBLE + coalesce(corr, 0), 6) AS score FROM (SELECT incident_id, s, count(*) AS cnt FROM (SELECT incident_id, entry, unnest(path[greatest(1, len(path) - 1):]) AS s FROM best) WHERE s <> entry GROUP BY 1, 2) c LEFT JOIN corr k ON k.incident_id = c.incident_id AND k.service_id = c.s")
def _(x):
    return v6(gr.ranknode(x.scored().withColumn("prob", F.round("prob", 9)), x.corr(), 20, 2, 0.35), "score")


MONITOR = """, fw AS (SELECT e.incident_id, src, dst, corr AS weight FROM edges e JOIN corr c ON c.incident_id = e.incident_id AND c.service_id = e.dst),
  bw AS (SELECT e.incident_id, dst AS src, src AS dst, 0.3::DOUBLE * corr AS weight FROM edges e JOIN corr c ON c.incident_id = e.incident_id AND c.service_id = e.src WHERE NOT EXISTS (SELECT 1 FROM edges f WHERE f.incident_id = e.incident_id AND f.src = e.dst AND f.dst = e.src)),
  bo AS (SELECT * FROM fw UNION ALL SELECT * FROM bw), mx AS (SELECT incident_id, src, max(weight) AS m FROM bo GROUP BY 1, 2),
  se AS (SELECT c.incident_id, c.service_id AS src, c.service_id AS dst, greatest(0, corr - coalesce(m, 0)) AS weight FROM corr c LEFT JOIN mx ON mx.incident_id = c.incident_id AND mx.src = c.service_id WHERE c.service_id <> 1),
  tr AS (SELECT * FROM bo UNION ALL SELECT * FROM se WHERE weight > 0)"""


@add("r6_monitor_rank_transition", MONITOR + "SELECT incident_id, src, dst, round(weight / sum(weight) OVER (PARTITION BY incident_id, src), 6) AS weight FROM tr")
def _(x):
    return v6(gr.monitor_rank_transition(x.edges(), x.corr(), x.entries(), 0.3), "weight").select("incident_id", "src", "dst", "weight")


CLOUD = """, p0 AS (SELECT e.incident_id, src, dst, corr AS w FROM edges e JOIN corr c ON c.incident_id = e.incident_id AND c.service_id = e.dst), p AS (SELECT incident_id, src, dst, w / sum(w) OVER (PARTITION BY incident_id, src) AS w FROM p0),
  f AS (SELECT a.incident_id, a.src AS prev, a.dst AS cur, b.dst AS nxt, 0.7::DOUBLE * a.w + 0.3::DOUBLE * b.w AS prob FROM p a JOIN p b ON a.incident_id = b.incident_id AND a.dst = b.src),
  b AS (SELECT a.incident_id, a.src AS prev, a.dst AS cur, i.src AS nxt, 0.2::DOUBLE * (0.7::DOUBLE * a.w + 0.3::DOUBLE * i.w) AS prob FROM p a JOIN p i ON a.incident_id = i.incident_id AND a.dst = i.dst WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.incident_id = a.incident_id AND f.prev = a.src AND f.cur = a.dst AND f.nxt = i.src)),
  bo AS (SELECT incident_id, prev, cur, nxt, prob / nullif(sum(prob) OVER w, 0) AS prob FROM f WINDOW w AS (PARTITION BY incident_id, prev, cur) UNION ALL SELECT incident_id, prev, cur, nxt, prob / nullif(sum(prob) OVER w, 0) FROM b WINDOW w AS (PARTITION BY incident_id, prev, cur)),
  mx AS (SELECT bo.incident_id, prev, cur, max(corr) AS m FROM bo JOIN corr c ON c.incident_id = bo.incident_id AND c.service_id = bo.nxt WHERE nxt <> cur GROUP BY 1, 2, 3),
  se AS (SELECT mx.incident_id, prev, cur, cur AS nxt, greatest(0, corr - m) AS prob FROM mx JOIN corr c ON c.incident_id = mx.incident_id AND c.service_id = mx.cur WHERE NOT EXISTS (SELECT 1 FROM bo WHERE bo.incident_id = mx.incident_id AND bo.prev = mx.prev AND bo.cur = mx.cur AND bo.nxt = mx.cur)),
  al AS (SELECT * FROM bo WHERE prob > 0 UNION ALL SELECT * FROM se WHERE prob > 0)"""


@add("r8_cloud_ranger_transition", CLOUD + """
  SELECT incident_id, prev, cur, nxt AS next, round(prob / sum(prob) OVER (PARTITION BY incident_id, prev, cur), 6) AS prob FROM al""")
def _(x):
    return v6(gr.cloud_ranger_transition(x.edges(), x.corr(), 0.3, 0.2), "prob").select("incident_id", "prev", "cur", "next", "prob")


@add("r10_netmedic_edge_weight", CHUNKS + """, st AS (SELECT incident_id, service_id, avg(value) FILTER (part = 'current') AS cur, min(value) AS lo, max(value) AS hi FROM parts GROUP BY 1, 2),
  df AS (SELECT incident_id, service_id, chunk, coalesce(abs(mean - cur) / nullif(hi - lo, 0), 0) AS d FROM ch JOIN st USING (incident_id, service_id)),
  w AS (SELECT e.incident_id, e.src, e.dst, CASE WHEN s.d <= 1.0::DOUBLE / 3 THEN 1 - s.d ELSE 0 END AS w, d.d AS d FROM edges e JOIN df s ON s.incident_id = e.incident_id AND s.service_id = e.src JOIN df d ON d.incident_id = e.incident_id AND d.service_id = e.dst AND d.chunk = s.chunk)
  SELECT incident_id, src, dst, round(CASE WHEN sum(w) > 0 THEN sum(w * (1 - d)) / sum(w) ELSE 0.8 END, 6) AS weight FROM w GROUP BY 1, 2, 3""")
def _(x):
    parts = x.parts()
    return v6(gr.netmedic_edge_weight(x.edges(), rl.history_stats(parts), rl.chunk_means(parts.where("part = 'history'"), 6), None, 6), "weight")


def _forward_sql(edges, nodes):
    return f""", fwalk AS (SELECT incident_id, src AS c, [src] AS path, []::DOUBLE[] AS probs FROM (SELECT DISTINCT incident_id, src FROM (SELECT incident_id, src FROM {edges} UNION ALL SELECT incident_id, dst FROM {edges}))
    UNION ALL SELECT w.incident_id, w.c, list_append(w.path, e.dst), list_append(w.probs, e.weight) FROM fwalk w JOIN {edges} e ON e.incident_id = w.incident_id AND e.src = w.path[-1] WHERE len(w.path) < {nodes} AND NOT list_contains(w.path, e.dst)),
  fp AS (SELECT w.*, path[-1] AS e FROM fwalk w WHERE len(path) > 1 AND (NOT EXISTS (SELECT 1 FROM {edges} e WHERE e.incident_id = w.incident_id AND e.src = w.path[-1]) OR EXISTS (SELECT 1 FROM {edges} e WHERE e.incident_id = w.incident_id AND e.src = w.path[-1] AND list_contains(w.path, e.dst)))),
  im AS (SELECT a.incident_id, a.service_id AS c, b.service_id AS e, CASE WHEN a.service_id = b.service_id THEN 1.0::DOUBLE ELSE coalesce((SELECT max(exp(list_sum([ln(p) for p in probs]) / len(probs))) FROM fp WHERE fp.incident_id = a.incident_id AND fp.c = a.service_id AND fp.e = b.service_id), 0.01) END AS impact FROM nodes a JOIN nodes b USING (incident_id))"""


FORWARD = _forward_sql("edges", 3)


@add("r11_netmedic_paths", FORWARD + "SELECT incident_id, c, e, array_to_string(path, ',') AS path FROM fp")
def _(x):
    return gr.netmedic_paths(x.edges(), 3).select("incident_id", "c", "e", F.concat_ws(",", F.transform("path", lambda s: s.cast("string"))).alias("path"))


@add("r12_impact_matrix", FORWARD + "SELECT incident_id, c, e, round(impact, 6) AS impact FROM im")
def _(x):
    return v6(full_impact(best_impacts(x.edges(), 3), x.nodes()), "impact")


@add("r13_netmedic_rank", FORWARD + ", gi AS (SELECT i.incident_id, i.c AS service_id, sum(impact * corr) AS g FROM im i JOIN corr k ON k.incident_id = i.incident_id AND k.service_id = i.e GROUP BY 1, 2) SELECT i.incident_id, i.c AS service_id, round(1 / (i.impact * g), 4) AS score FROM im i JOIN gi ON gi.incident_id = i.incident_id AND gi.service_id = i.c WHERE i.e = 1")
def _(x):
    imp = cut(full_impact(best_impacts(x.edges(), 3), x.nodes()))
    g = rl.global_impact(imp, x.corr().withColumnRenamed("corr", "abnormality"))
    return gr.netmedic_rank(imp, g, x.entries()).withColumn("score", F.round("score", 4))


def _reach_sql(name, a, b, depth=6):
    return f""", {name}w AS (SELECT DISTINCT incident_id, {a} AS service_id, {b} AS other, 1 AS depth FROM edges UNION SELECT w.incident_id, w.service_id, e.{b}, w.depth + 1 FROM {name}w w JOIN edges e ON e.incident_id = w.incident_id AND e.{a} = w.other WHERE w.depth < {depth}),
  {name} AS (SELECT incident_id, service_id, other, min(depth) AS depth FROM {name}w WHERE service_id <> other GROUP BY 1, 2, 3)"""


@add("r14_callers", _reach_sql("ca", "src", "dst") + "SELECT * FROM ca")
def _(x):
    return gr.reach(x.edges(), "callers", 6)


@add("r14_callees", _reach_sql("ce", "dst", "src") + "SELECT * FROM ce")
def _(x):
    return gr.reach(x.edges(), "callees", 6)


def _rating_sql(corr, depth):
    return _reach_sql("ca", "src", "dst", depth) + _reach_sql("ce", "dst", "src", depth) + f""", s AS (SELECT incident_id, service_id, 2 * {corr} - 1 AS s FROM corr),
  si AS (SELECT ca.incident_id, ca.service_id, sum(s / depth) / sum(1.0::DOUBLE / depth) AS i FROM ca JOIN s ON s.incident_id = ca.incident_id AND s.service_id = ca.other GROUP BY 1, 2),
  so AS (SELECT ce.incident_id, ce.service_id, max(s) AS o FROM ce JOIN s ON s.incident_id = ce.incident_id AND s.service_id = ce.other GROUP BY 1, 2),
  vs AS (SELECT incident_id, service_id, CASE WHEN coalesce(i <= s, true) AND coalesce(o > s, true) THEN (s - 1) / 2 WHEN coalesce(i > s, true) AND coalesce(o <= s, true) THEN (s + 1) / 2 ELSE s END AS score FROM s LEFT JOIN si USING (incident_id, service_id) LEFT JOIN so USING (incident_id, service_id))"""


@add("r15_tbac_rating", _rating_sql("round(corr, 9)", 6) + " SELECT incident_id, service_id, round(score, 6) AS score FROM vs")
def _(x):
    c = x.corr().withColumn("corr", F.round("corr", 9))
    return v6(gr.tbac_rating(c, *gr.reach_both(x.edges(), 6)), "score")


MICRO = """, z AS (SELECT incident_id, service_id, CASE WHEN service_id = 1 THEN 0 ELSE corr END AS c FROM corr), bo AS (SELECT e.incident_id, src, dst, c AS weight FROM edges e JOIN z ON z.incident_id = e.incident_id AND z.service_id = e.dst
    UNION ALL SELECT e.incident_id, e.dst, e.src, 0.2::DOUBLE * c FROM edges e JOIN z ON z.incident_id = e.incident_id AND z.service_id = e.src WHERE NOT EXISTS (SELECT 1 FROM edges f WHERE f.incident_id = e.incident_id AND f.src = e.dst AND f.dst = e.src)),
  mx AS (SELECT incident_id, src, max(weight) AS m FROM bo GROUP BY 1, 2), al AS (SELECT * FROM bo UNION ALL SELECT z.incident_id, service_id, service_id, greatest(0, c - m) FROM z JOIN mx ON mx.incident_id = z.incident_id AND mx.src = z.service_id)"""


@add("r16_microcause_q", MICRO + """
  SELECT incident_id, src, dst, round(weight / sum(weight) OVER (PARTITION BY incident_id, src), 6) AS weight FROM al WHERE weight > 0""")
def _(x):
    return v6(gr.microcause_q(x.edges(), x.corr(), x.entries(), 0.2), "weight")


#: Partial correlations with the entry: of each service's block of correlations, confounders are eliminated one by one (``el``), as many as there are.
PARTIAL = """, pa AS (SELECT incident_id, dst AS s, src AS p FROM edges), nd AS (SELECT DISTINCT incident_id, s FROM (SELECT incident_id, src AS s FROM edges UNION ALL SELECT incident_id, dst FROM edges) WHERE s <> 1),
  co AS (SELECT nd.incident_id, nd.s, coalesce(list(DISTINCT pa.p) FILTER (pa.p IS NOT NULL), []) AS cond FROM nd LEFT JOIN pa ON pa.incident_id = nd.incident_id AND (pa.s = nd.s OR pa.s = 1) AND pa.p <> 1 AND pa.p <> nd.s GROUP BY 1, 2),
  pc AS (SELECT a.incident_id, a.service_id AS i, b.service_id AS j, CASE WHEN a.service_id = b.service_id THEN 1.0::DOUBLE ELSE corr(a.value, b.value) END AS m FROM filled a JOIN filled b USING (incident_id, t) GROUP BY 1, 2, 3),
  el AS (SELECT co.incident_id, s, cond, 1 AS k, i, j, m FROM co JOIN pc ON pc.incident_id = co.incident_id AND list_contains(cond || [1, s], i) AND list_contains(cond || [1, s], j)
    UNION ALL
    SELECT a.incident_id, a.s, a.cond, a.k + 1, a.i, a.j, a.m - b.m * c.m / d.m FROM el a JOIN el b ON b.incident_id = a.incident_id AND b.s = a.s AND b.i = a.i AND b.j = a.cond[a.k]
      JOIN el c ON c.incident_id = a.incident_id AND c.s = a.s AND c.i = a.cond[a.k] AND c.j = a.j JOIN el d ON d.incident_id = a.incident_id AND d.s = a.s AND d.i = a.cond[a.k] AND d.j = a.cond[a.k]
    WHERE a.k <= len(a.cond) AND a.i <> a.cond[a.k] AND a.j <> a.cond[a.k]),
  pr AS (SELECT x.incident_id, x.s AS service_id, abs(x.m / sqrt(e.m * o.m)) AS corr FROM el x JOIN el e ON e.incident_id = x.incident_id AND e.s = x.s AND e.k = x.k AND e.i = 1 AND e.j = 1
    JOIN el o ON o.incident_id = x.incident_id AND o.s = x.s AND o.k = x.k AND o.i = x.s AND o.j = x.s WHERE x.k = len(x.cond) + 1 AND x.i = 1 AND x.j = x.s)"""


def partial(x):
    return cz.partial_correlations(rl.pearson_matrix(x.filled()), x.entries(), rl.confounders(x.edges(), x.entries()))


@add("g10_partial_corr", PARTIAL + " SELECT incident_id, service_id, round(corr, 6) AS corr FROM pr")
def _(x):
    return v6(partial(x), "corr")


@add("r17_microcause_q_partial", PARTIAL + """, fl AS (SELECT incident_id, dst AS src, src AS dst FROM edges),
  bo AS (SELECT fl.incident_id, src, dst, corr AS weight FROM fl JOIN pr ON pr.incident_id = fl.incident_id AND pr.service_id = fl.dst
    UNION ALL SELECT fl.incident_id, fl.dst, fl.src, 0.2::DOUBLE * corr FROM fl JOIN pr ON pr.incident_id = fl.incident_id AND pr.service_id = fl.src WHERE NOT EXISTS (SELECT 1 FROM fl o WHERE o.incident_id = fl.incident_id AND o.src = fl.dst AND o.dst = fl.src))
  SELECT incident_id, src, dst, round(weight / sum(weight) OVER (PARTITION BY incident_id, src), 6) AS weight FROM bo WHERE weight > 0""")
def _(x):
    return v6(gr.microcause_q(x.edges(), partial(x), x.entries(), 0.2, selves=False, flip=True), "weight")


@add("r19_gamma_scores", ", v AS (SELECT incident_id, dst AS service_id, sum(weight) AS visits FROM strength GROUP BY 1, 2) SELECT incident_id, service_id, round(0.6::DOUBLE * visits / max(visits) OVER w + 0.4::DOUBLE * corr / max(corr) OVER w, 6) AS score FROM v JOIN corr USING (incident_id, service_id) WINDOW w AS (PARTITION BY incident_id)")
def _(x):
    v = x.strength().groupBy("incident_id", F.col("dst").alias("service_id")).agg(F.sum("weight").alias("visits"))
    return v6(gr.gamma_scores(v, x.corr().withColumnRenamed("corr", "eta"), 0.6), "score")


#: Visits of a walk of N steps: mass moves along ``st`` (incident_id, a, b, w) from the entry; what reaches a dead end jumps by ``jp`` (incident_id, b, w).
WALK = """, wk AS (SELECT 0 AS k, incident_id, service_id AS a, 1.0::DOUBLE AS m FROM entries
  UNION ALL SELECT k + 1, incident_id, b, sum(m) FROM (SELECT k, wk.incident_id, st.b, wk.m * st.w AS m FROM wk JOIN st ON st.incident_id = wk.incident_id AND st.a = wk.a
    UNION ALL SELECT k, wk.incident_id, jp.b, wk.m * jp.w FROM wk JOIN jp ON jp.incident_id = wk.incident_id WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.incident_id = wk.incident_id AND st.a = wk.a)) WHERE k < %d GROUP BY 1, 2, 3)"""


VISITS = MONITOR + """, st AS (SELECT incident_id, src AS a, dst AS b, weight / sum(weight) OVER (PARTITION BY incident_id, src) AS w FROM tr),
  jp AS (SELECT incident_id, service_id AS b, corr / sum(corr) OVER (PARTITION BY incident_id) AS w FROM corr)""" + WALK % 100 + """,
  vs AS (SELECT c.incident_id, c.service_id, coalesce(m, 0) AS score FROM corr c LEFT JOIN (SELECT incident_id, a, sum(m) AS m FROM wk WHERE k > 0 GROUP BY 1, 2) v ON v.incident_id = c.incident_id AND v.a = c.service_id)"""


@add("r7_first_order_walk", VISITS + " SELECT incident_id, service_id, round(score, 6) AS visits FROM vs")
def _(x):
    p, corr = gr.monitor_rank_transition(x.edges(), x.corr(), x.entries(), 0.3), x.corr().withColumnRenamed("corr", "weight")
    return v6(gr.expected_visits(p, x.entries(), 100, corr, restart=False), "visits")


@add("r18_restarting_walk", MICRO + """, st AS (SELECT incident_id, src AS a, dst AS b, weight / sum(weight) OVER (PARTITION BY incident_id, src) AS w FROM al WHERE weight > 0),
  jp AS (SELECT incident_id, 0 AS b, 0.0::DOUBLE AS w FROM entries WHERE FALSE)""" + WALK % 50 + """
  SELECT n.incident_id, n.s AS service_id, round(coalesce(m, 0), 6) AS visits FROM (SELECT incident_id, a AS s FROM st UNION SELECT incident_id, b FROM st UNION SELECT incident_id, service_id FROM entries WHERE incident_id IN (SELECT incident_id FROM st)) n
  LEFT JOIN (SELECT incident_id, a, sum(m) AS m FROM wk WHERE k > 0 GROUP BY 1, 2) v ON v.incident_id = n.incident_id AND v.a = n.s""")
def _(x):
    return v6(gr.expected_visits(gr.microcause_q(x.edges(), x.corr(), x.entries(), 0.2), x.entries(), 50), "visits")


VISITS_2 = CLOUD + """, st AS (SELECT incident_id, prev, cur, nxt, prob / sum(prob) OVER (PARTITION BY incident_id, prev, cur) AS w FROM al),
  f1 AS (SELECT DISTINCT incident_id, cur FROM st WHERE prev = 1), own AS (SELECT incident_id FROM f1 WHERE cur = 1),
  s0 AS (SELECT incident_id, cur, CASE WHEN incident_id IN (SELECT incident_id FROM own) THEN (cur = 1)::INT ELSE 1 / count(*) OVER (PARTITION BY incident_id) END AS m FROM f1),
  wk AS (SELECT 0 AS k, incident_id, 1 AS p, cur AS c, m::DOUBLE AS m FROM s0
    UNION ALL SELECT k + 1, incident_id, c, n, sum(m) FROM (SELECT k, wk.incident_id, st.cur AS c, st.nxt AS n, wk.m * st.w AS m FROM wk JOIN st ON st.incident_id = wk.incident_id AND st.prev = wk.p AND st.cur = wk.c) WHERE k < 50 GROUP BY 1, 2, 3, 4),
  vs AS (SELECT n.incident_id, n.s AS service_id, coalesce(m, 0) AS score FROM (SELECT incident_id, cur AS s FROM st UNION SELECT incident_id, nxt FROM st UNION SELECT incident_id, 1 FROM st) n
  LEFT JOIN (SELECT incident_id, c, sum(m) AS m FROM wk WHERE k > 0 GROUP BY 1, 2) v ON v.incident_id = n.incident_id AND v.c = n.s)"""


@add("r9_second_order_walk", VISITS_2 + " SELECT incident_id, service_id, round(score, 6) AS visits FROM vs")
def _(x):
    return v6(gr.second_order_visits(gr.cloud_ranger_transition(x.edges(), x.corr(), 0.3, 0.2), x.entries(), 50), "visits")


@add("r5_resample_graph_by_walk", """, pr AS (SELECT incident_id, dst AS a, src AS b, 0.8::DOUBLE * weight / sum(weight) OVER (PARTITION BY incident_id, dst) AS w FROM edges),
  st AS (SELECT * FROM pr UNION ALL SELECT incident_id, src, dst, 0.1::DOUBLE * weight / sum(weight) OVER (PARTITION BY incident_id, src) FROM edges
    UNION ALL SELECT incident_id, s, s, 0.1::DOUBLE FROM (SELECT incident_id, src AS s FROM edges UNION SELECT incident_id, dst FROM edges)),
  jp AS (SELECT incident_id, 0 AS b, 0.0::DOUBLE AS w FROM entries WHERE FALSE)""" + WALK % 50 + """,
  us AS (SELECT pr.incident_id, pr.b AS src, pr.a AS dst, pr.w * v.m AS weight FROM pr JOIN (SELECT incident_id, a, sum(m) AS m FROM wk GROUP BY 1, 2) v ON v.incident_id = pr.incident_id AND v.a = pr.a WHERE pr.w * v.m > 0)
  SELECT incident_id, src, dst, round(weight / sum(weight) OVER (PARTITION BY incident_id, dst), 6) AS weight FROM us""")
def _(x):
    return v6(gr.resample_graph_by_walk(x.edges(), x.entries(), 50), "weight").select("incident_id", "src", "dst", "weight")


@add("r20_graph_at", PATH_EDGES + ", l AS (SELECT *, cnt / (max(cnt) OVER (PARTITION BY incident_id, x, y))::DOUBLE AS w FROM curves) SELECT l.incident_id, src, dst, round(w, 6) AS weight FROM l JOIN pe ON pe.incident_id = l.incident_id AND pe.src = l.x AND pe.dst = l.y WHERE t = 300 AND w > 0.1")
def _(x):
    return v6(gr.graph_at(x.curves(), rl.path_edges(x.paths()), 300, 0.1), "weight").select("incident_id", "src", "dst", "weight")


@add("t9_stream_prepare", "SELECT incident_id, service_id, date_diff('hour', TIMESTAMP '2024-01-01', time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01')) AS h, round(sum(value), 2) AS value FROM ev GROUP BY 1, 2, 3")
def _(x):
    e = x.events().withColumn("ts", F.expr("cast(cast(ts AS string) || ' UTC' AS timestamp)"))
    d = stream_prepare(e.select("ts", "value", "incident_id", "service_id"), "6 hours", "1 hour", F.col("incident_id"), F.col("service_id"))
    return d.select("incident_id", "service_id", F.expr("(unix_seconds(start) - unix_seconds(timestamp'2024-01-01 00:00:00 UTC')) div 3600").alias("h"), F.round("value", 2).alias("value"))


def _hours(c: str):
    return F.expr(f"(unix_seconds({c}) - unix_seconds(timestamp'2024-01-01 00:00:00 UTC')) div 3600")


def _event_job(x, transform):
    """A streaming job over the table's own files, run until all windows are closed."""
    e = x.read("events")
    job = EventJob(x.spark, f"{x.dir}/events.parquet", e.schema, shared_folder(x.spark, "stream"), transform)
    job.run()
    return job.close()


@add("t9_stream_buckets", "SELECT incident_id, service_id, date_diff('hour', TIMESTAMP '2024-01-01', time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01')) AS h, round(sum(value), 2) AS value FROM ev GROUP BY 1, 2, 3")
def _(x):
    user = F.col("user_id")
    d = _event_job(x, lambda e: stream_prepare(e, "6 hours", "1 hour", F.concat(F.lit("i"), F.floor(user / 36)), (F.floor(user / 3) % 12 + 1).cast("int")))
    return d.select("incident_id", "service_id", _hours("start").alias("h"), F.round("value", 2).alias("value"))


@add("p11_stream_trips", """, g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS trip FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, trip""")
def _(x):
    d = _event_job(x, lambda e: stream_trips(e, "6 hours", "1 hour", "user_id"))
    return d.select("user_id", F.unix_micros("start").alias("start"), "n")


# The same series operators over ranges of t: the same SQL.
for _name, _run in CHUNKED.items():
    CATALOG[f"{_name}_chunks"] = (lambda spark, d, f=_run: f(Tables(spark, d)), CATALOG[_name][1])


# The flagship: when each incident starts, and how many services are unstable then.
def flagship(x: Tables):
    return rl.anomaly_start(rl.anomaly_score(x.stds()), x.services())


# Whole diagnoses over a given graph: the score of the method, its ranking, its evaluation
JUDGED = """, rk AS (SELECT incident_id, service_id, score, row_number() OVER (PARTITION BY incident_id ORDER BY score DESC NULLS LAST, service_id)::INT AS rank FROM vs),
  tn AS (SELECT incident_id, count(*) AS n FROM truth GROUP BY 1), sn AS (SELECT incident_id, count(*) AS a FROM services GROUP BY 1),
  ht AS (SELECT rk.incident_id, rank, n, t.service_id IS NOT NULL AS hit FROM rk JOIN tn USING (incident_id) LEFT JOIN truth t ON t.incident_id = rk.incident_id AND t.service_id = rk.service_id),
  pv AS (SELECT incident_id, (""" + " + ".join(f"count(*) FILTER (hit AND rank <= {k}) / least(any_value(n), {k})::DOUBLE" for k in range(1, 6)) + """) / 5 AS pr_avg FROM ht GROUP BY 1),
  av AS (SELECT t.incident_id, avg(CASE WHEN r.rank IS NULL THEN 0 ELSE (a - greatest(0, r.rank - n)) / a::DOUBLE END) AS acc FROM truth t JOIN tn USING (incident_id) JOIN sn USING (incident_id) JOIN pv USING (incident_id) LEFT JOIN rk r ON r.incident_id = t.incident_id AND r.service_id = t.service_id GROUP BY 1)
  SELECT rk.incident_id, rk.service_id, round(score, 6) AS score, rank, round(pr_avg, 6) AS pr_avg, round(acc, 6) AS acc FROM rk LEFT JOIN pv USING (incident_id) LEFT JOIN av USING (incident_id)"""


def rounded(judgement):
    return v6(v6(v6(judgement.drop("prks"), "score"), "pr_avg"), "acc")


@add("y2_diagnose_monitor_rank", VISITS + JUDGED)
def _(x):
    return rounded(judged(x, "monitor_rank", True))


@add("y3_diagnose_cloud_ranger", VISITS_2 + JUDGED)
def _(x):
    return rounded(judged(x, "cloud_ranger", True))


@add("y5_diagnose_tbac", _rating_sql("corr", 20) + JUDGED)
def _(x):
    return rounded(judged(x, "tbac", True))


NETMEDIC = """, hh AS (SELECT incident_id, max(t) + 1 AS h, greatest(1, least(50, (max(t) + 1) // 100)) AS k FROM parts WHERE part = 'history' GROUP BY 1),
  ch AS (SELECT incident_id, service_id, (h - 1 - t) // (h // k) AS chunk, avg(value) AS mean FROM parts JOIN hh USING (incident_id) WHERE part = 'history' AND (h - 1 - t) // (h // k) < k GROUP BY 1, 2, 3),
  st AS (SELECT incident_id, service_id, avg(value) FILTER (part = 'current') AS cur, min(value) AS lo, max(value) AS hi FROM parts GROUP BY 1, 2),
  df AS (SELECT incident_id, service_id, chunk, coalesce(abs(mean - cur) / nullif(hi - lo, 0), 0) AS d FROM ch JOIN st USING (incident_id, service_id)),
  lk AS (SELECT e.incident_id, e.src, e.dst, CASE WHEN s.d <= 1.0::DOUBLE / 3 THEN 1 - s.d ELSE 0 END AS w, d.d AS d FROM edges e JOIN df s ON s.incident_id = e.incident_id AND s.service_id = e.src JOIN df d ON d.incident_id = e.incident_id AND d.service_id = e.dst AND d.chunk = s.chunk),
  ne AS (SELECT * FROM (SELECT incident_id, src, dst, CASE WHEN sum(w) > 0 THEN sum(w * (1 - d)) / sum(w) ELSE 0.8 END AS weight FROM lk GROUP BY 1, 2, 3) WHERE weight > 0)"""
GLOBAL = """, gi AS (SELECT i.incident_id, i.c AS service_id, sum(impact * coalesce(abnormality, 0)) AS g FROM im i JOIN am ON am.incident_id = i.incident_id AND am.service_id = i.e GROUP BY 1, 2),
  vs AS (SELECT i.incident_id, i.c AS service_id, 1 / nullif(i.impact * g, 0) AS score FROM im i JOIN gi ON gi.incident_id = i.incident_id AND gi.service_id = i.c WHERE i.e = 1)"""


@add("y4_diagnose_netmedic", NETMEDIC + ABNORMALITY + _forward_sql("ne", 1000) + GLOBAL + JUDGED.replace("score DESC", "score ASC"))
def _(x):
    return rounded(judged(x, "netmedic", True))
