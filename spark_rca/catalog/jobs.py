"""Queries of operators that SQL can't express: tests check them against numpy or other independent forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_rca.catalog.fixtures import T, Tables
from spark_rca.operators import causality as cz
from spark_rca.operators import graph as gr
from spark_rca.operators import prepare as pp
from spark_rca.operators import relate as rl
from spark_rca.operators.lineage import cut, shared_folder
from spark_rca.operators.spline import fill_spline
from spark_rca.plans import diagnose as dg
from spark_rca.streaming.runs import drain, read_sink
from spark_rca.streaming.spot import append_batch, fit_tails, run_spot, stream_spot

WINDOW_GRID = {
    "dynamic_causality": [{"bef": 100, "step": 25}],
    "monitor_rank": [{"rho": 0.2}, {"rho": 0.5}],
    "cloud_ranger": [{"beta": 0.3, "rho": 0.2, "steps": 20}],
    "netmedic": [{"bins": 50, "max_len": 3}],
    "tbac": [{}],
}
GRAPH_GRID = {"monitor_rank": [{"rho": 0.2}, {"rho": 0.5}], "tbac": [{}], "dynamic_causality": [{"bef": 100, "step": 25}]}
PARAM_GRID = {"cloud_ranger": [{"beta": 0.3, "rho": r, "steps": 30} for r in (0.2, 0.5)], "dynamic_causality": [{"step": 20, "sig": s} for s in (0.05, 0.1)]}


def judged(x: Tables, method: str, graph: bool = False, **params) -> DataFrame:
    """A diagnosis and its evaluation, from metrics that are aggregated once."""
    metrics, edges = cut(x.metrics()), cut(x.edges()) if graph else None
    services = metrics.select("incident_id", "service_id").distinct()
    entries, truth = services.where("service_id = 1"), services.where("service_id IN (3, 5)")
    return dg.evaluated(dg.diagnose(method, metrics, entries, edges, **params), truth, services)


def reused_intervals(x: Tables) -> DataFrame:
    """Interval tests as a second run finds them: stored under their parameters and read again."""
    d = dg.prepare(x.dense())
    store = shared_folder(x.spark, "intervals")
    for _ in range(2):
        tests = dg.stored_tests(d, 72, 3, 0.1, store, dg.interval_key(0, 0, 72, 3, 0.1))
    return tests.drop("params_id")


def appended(x: Tables, **options) -> DataFrame:
    """All rows of a series that comes in two halves, the second appended to the state that the first has left."""
    d, store = cut(x.filled()), shared_folder(x.spark, "spot")
    half = F.col("t") < T // 2
    return append_batch(x.spark, store, 0, d.where(half), **options).unionByName(append_batch(x.spark, store, 1, d.where(~half), **options))


def streamed(x: Tables, **options) -> DataFrame:
    """The same as a stream whose files come in two halves, each taken by a run of the job."""
    d, folder = cut(x.filled()), shared_folder(x.spark, "spot")
    half = F.col("t") < T // 2
    for part in (d.where(half), d.where(~half)):
        part.write.mode("append").parquet(f"{folder}/in")
        drain(stream_spot(x.spark.readStream.schema(d.schema).parquet(f"{folder}/in"), **options), folder)
    return read_sink(x.spark, folder)


JOBS = {
    "p5_fill_cubic": lambda x: fill_spline(x.metrics(), "cubic"),
    "p5_fill_quadratic": lambda x: fill_spline(x.metrics(), "quadratic"),
    "g1_granger_f": lambda x: cz.granger_f(cz.packed_pairs(x.dense()), 3),
    "g2_granger_intervals": lambda x: cz.granger_intervals(x.dense(), 72, 3),
    "g3_adf_pvalue": lambda x: cz.adf_pvalues(x.dense()),
    "g4_granger_stationary": lambda x: cz.granger_intervals(x.dense(), 72, 3, adf=True).where("accepted"),
    "g6_granger_full_graph": lambda x: cz.granger_full_graph(x.filled(), 2, 0.05),
    "g7_granger_verdict": lambda x: cz.granger_verdict(x.dense(), 2),
    "g8_pc_graph": lambda x: cz.pc_graph(rl.pearson_matrix(x.filled()), x.lengths(), 0.1),
    "g9_lagged_links": lambda x: cz.lagged_links(x.dense(), 10),
    "t1_spot": lambda x: run_spot(x.filled(), q=1e-3),
    "t2_bispot": lambda x: run_spot(x.filled(), q=1e-3, two_sided=True),
    "t3_dspot": lambda x: run_spot(x.filled(), q=1e-3, depth=10),
    "t4_bidspot": lambda x: run_spot(x.filled(), q=1e-4, depth=10, two_sided=True),
    "t7_adapt_mode": lambda x: run_spot(x.filled(), q=1e-3, adapt=True),
    "t5_gpd_fit": lambda x: fit_tails(x.filled(), 0.9),
    "t8_append_stream": lambda x: appended(x, n_init=200, q=1e-3),
    "t1_stream_spot": lambda x: streamed(x, n_init=200, q=1e-3),
    "t4_stream_bidspot": lambda x: streamed(x, n_init=200, q=1e-4, depth=10, two_sided=True),
    "io5_stored_intervals": lambda x: reused_intervals(x),
    "g8_dependency_graph": lambda x: dg.dependency_graph(x.metrics()),
    "y1_diagnose_dynamic_causality": lambda x: judged(x, "dynamic_causality"),
    "y2_monitor_rank_own_graph": lambda x: judged(x, "monitor_rank"),
    "y3_cloud_ranger_own_graph": lambda x: judged(x, "cloud_ranger"),
    "y4_netmedic_raw_samples": lambda x: judged(x, "netmedic", True, compat=True),
    "y6_diagnose_microcause": lambda x: judged(x, "microcause"),
    "y7_sweep_windows": lambda x: dg.best_of_sweep(dg.sweep_windows(x.metrics(), x.entries(), x.truth(), x.edges(), 400, [200, 400], WINDOW_GRID)),
    "y7_sweep_own_graphs": lambda x: dg.sweep_reports(dg.sweep_windows(x.metrics(), x.entries(), x.truth(), None, 400, [200, 400], GRAPH_GRID, [(1, 0.1), (20, 0.1)]))["top5"].drop("time_mean"),
    "y8_sweep_microcause": lambda x: dg.sweep_params(x.metrics(), x.entries(), x.truth(), None, {"microcause": [{"tau_max": 3, "rho": r, "lam": v} for r in (0.2, 0.5) for v in (0.5, 0.8)]}),
    "y8_sweep_params": lambda x: dg.sweep_params(x.metrics(), x.entries(), x.truth(), x.edges(), PARAM_GRID),
    "y9_compare_thresholds": lambda x: dg.compare_thresholds(x.strength(), pp.zscore(x.filled()), x.entries(), x.truth(), [0.5, 0.8], [150.0]),
}


def jobs() -> dict:
    return {name: (lambda spark, d, f=f: f(Tables(spark, d))) for name, f in JOBS.items()}
