"""User-facing jobs: one diagnosis per method, sweeps and comparisons, for all incidents at once."""

from __future__ import annotations

import inspect
import time
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spark_rca.functions.scalars import abnormality
from spark_rca.operators import causality as cz
from spark_rca.operators import graph as gr
from spark_rca.operators import prepare as pp
from spark_rca.operators import relate as rl
from spark_rca.operators import windows as wn
from spark_rca.operators.impact import best_impacts, full_impact
from spark_rca.operators.lineage import cut
from spark_rca.plans.points import Points
from spark_rca.sources.metrics import append_results, load_intervals, missing_incidents, save_tests, series_digests
from spark_rca.streaming.spot import run_spot


def prepare(metrics: DataFrame, bucket: int = 1) -> DataFrame:
    """Buckets, zero fill and z-score; constant series become 0."""
    d = pp.zscore(pp.fill_zeros(pp.bucket_sum(metrics, bucket)))
    return d.withColumn("value", F.coalesce("value", F.lit(0.0)))


def ready(metrics: DataFrame, prepared: bool, bucket: int = 1) -> DataFrame:
    """``metrics`` prepared, or, where that is done already, only summed in buckets: zeros of a z-score are values."""
    return pp.bucket_sum(metrics, bucket) if prepared else prepare(metrics, bucket)


def incident_start(prepared: DataFrame, w: int = 50, proportion: float = 0.0) -> DataFrame:
    return rl.anomaly_start(rl.anomaly_score(wn.rolling_std(prepared, w)), prepared.select("incident_id", "service_id").distinct(), proportion)


def dynamic_causality(prepared: DataFrame, starts: DataFrame, bef: int, aft: int, step: int, lag: int, sig: float) -> DataFrame:
    """Causality strengths (area under each pair's curve) around the start of each incident."""
    local = pp.slice_incident(prepared, starts, bef, aft)
    tests = cz.granger_intervals(local, step, lag, sig)
    pairs = rl.service_pairs(prepared.select("incident_id", "service_id").distinct())
    return rl.edge_strength(tests.where("accepted"), pairs)


def rank_from_strength(strength: DataFrame, local: DataFrame, entries: DataFrame, ratio: float = 0.8, **rank) -> DataFrame:
    return _rank(strength, rl.entry_correlation(local, entries), entries, ratio, **rank)


def _rank(strength: DataFrame, corr: DataFrame, entries: DataFrame, ratio: float | Column, max_len: int = 4, mean: str = "harmonic", topk: int = 50, num_sel: int = 1) -> DataFrame:
    paths = gr.best_paths(gr.transition_graph(strength, ratio), entries, max_len, topk, mean)
    return rl.rank_services(gr.ranknode(paths, corr, topk, num_sel), ["incident_id"])


def interval_key(bef: int, aft: int, step: int, lag: int, sig: float, min_len: int | None = None, max_len: int | None = None, adf: bool = False, bucket: int = 1) -> str:
    """The name under which interval tests are stored for reuse: every parameter that they depend on.  Their start is part of the data's digest."""
    return f"bef={bef},aft={aft},step={step},lag={lag},sig={sig:g},min={min_len},max={max_len},adf={adf},bucket={bucket}"


def stored_tests(local: DataFrame, step: int, lag: int, sig: float, store: str | None, key: str, **options) -> DataFrame:
    """Interval tests, kept in ``store`` under ``key`` and a digest of each incident's samples; only incidents that are not there are tested."""
    if store is None:
        return cz.granger_intervals(local, step, lag, sig, **options)
    spark = local.sparkSession
    incidents = cut(series_digests(local))
    missing = cut(missing_incidents(spark, store, key, incidents))
    if missing.take(1):
        fresh = local.join(missing.select("incident_id"), "incident_id", "left_semi")
        save_tests(cz.granger_intervals(fresh, step, lag, sig, **options), missing, store, key)
    return load_intervals(spark, store, key, incidents)


def diagnose_dynamic_causality(metrics: DataFrame, entries: DataFrame, bef: int = 100, aft: int = 0, step: int = 20, lag: int = 2, sig: float = 0.1, ratio: float = 0.8, max_len: int = 4, store: str | None = None, min_interval: int | None = None, max_interval: int | None = None, adf: bool = False, bucket: int = 1, prepared: bool = False, points: Points | None = None, **rank) -> DataFrame:
    """Ranking by dynamic causality curves: start, interval tests, threshold, backtrace, rank.

    With ``store``, interval tests of the same samples and parameters are read from that folder, others are added to it.
    Prepared series and the samples around the start are written once: start, tests and correlation read them.
    ``points`` have a sig and a ratio each: intervals are tested once, up to the largest sig.  A test that a sig needs is among those of a larger
    one; tests for stationarity and stored tests are not, so with these sig is one for all.
    """
    if points is not None:
        sig = points.most("sig")
    d = cut(ready(metrics, prepared, bucket))
    local = cut(pp.slice_incident(d, incident_start(d), bef, aft))
    options = {"min_len": min_interval, "max_len": max_interval, "adf": adf}
    tests = stored_tests(local, step, lag, sig, store, interval_key(bef, aft, step, lag, sig, bucket=bucket, **options), **options)
    pairs, corr = rl.service_pairs(metrics.select("incident_id", "service_id").distinct()), rl.entry_correlation(local, entries)
    accepted = tests.where("accepted")
    if points is not None:
        tests, pairs, corr, entries = (points.fan(cut(d)) for d in (accepted if adf or store else tests, pairs, corr, entries))
        accepted, ratio = tests if adf or store else cz.accept_intervals(tests, points.at("sig")), points.at("ratio")
    return _rank(rl.edge_strength(accepted, pairs), corr, entries, ratio, max_len, **rank)


def dependency_graph(metrics: DataFrame, alpha: float = 0.1, bucket: int = 1, prepared: bool = False) -> DataFrame:
    """The skeleton of dependencies of the prepared series, for methods that are given no call graph."""
    d = ready(metrics, prepared, bucket)
    return cz.pc_graph(rl.pearson_matrix(d), d.groupBy("incident_id").agg(F.count_distinct("t").alias("n")), alpha)


#: Decimals of a walk's scores that rank: services that it visits alike differ in the last bits of their sums.
WALK_DIGITS = 9


def diagnose_monitor_rank(metrics: DataFrame, entries: DataFrame, edges: DataFrame | None = None, rho: float = 0.3, steps: int = 100, alpha: float = 0.1, bucket: int = 1, prepared: bool = False, points: Points | None = None) -> DataFrame:
    """``alpha`` and ``bucket`` are those of the dependency graph that is built if none is given; ``points`` have a rho each."""
    edges = dependency_graph(metrics, alpha, bucket, prepared) if edges is None else edges
    corr = cut(rl.entry_correlation(ready(metrics, prepared), entries))
    if points is not None:
        edges, corr, entries, rho = points.fan(cut(edges)), points.fan(corr), points.fan(entries), points.at("rho")
    p = gr.monitor_rank_transition(edges, corr, entries, rho)
    jump = corr.select("incident_id", "service_id", F.abs("corr").alias("weight"))
    v = gr.expected_visits(p, entries, steps, jump, restart=False)
    return rl.rank_services(v.withColumnRenamed("visits", "score"), ["incident_id"], digits=WALK_DIGITS)


def diagnose_cloud_ranger(metrics: DataFrame, entries: DataFrame, edges: DataFrame | None = None, beta: float = 0.3, rho: float = 0.2, steps: int = 50, alpha: float = 0.1, bucket: int = 1, prepared: bool = False, points: Points | None = None) -> DataFrame:
    """``alpha`` and ``bucket`` are those of the dependency graph that is built if none is given; ``points`` have a beta and a rho each."""
    edges = dependency_graph(metrics, alpha, bucket, prepared) if edges is None else edges
    corr = cut(rl.entry_correlation(ready(metrics, prepared), entries))
    if points is not None:
        edges, corr, entries, beta, rho = points.fan(cut(edges)), points.fan(corr), points.fan(entries), points.at("beta"), points.at("rho")
    m = gr.cloud_ranger_transition(edges, corr, beta, rho)
    return rl.rank_services(gr.second_order_visits(m, entries, steps).withColumnRenamed("visits", "score"), ["incident_id"], digits=WALK_DIGITS)


def diagnose_netmedic(metrics: DataFrame, entries: DataFrame, edges: DataFrame, hist: tuple = (0, -60), cur: tuple = (-60, None), bins: int = 100, delta: float = 1 / 3, max_len: int | None = None, compat: bool = False, prepared: bool = False, points: Points | None = None) -> DataFrame:
    """Each incident has as many chunks as its own history gives; ``compat`` takes the source's first raw samples for its chunks.

    ``points`` have a delta each.
    """
    parts = cut(pp.slice_history_current(metrics if prepared else pp.fill_zeros(metrics), hist, cur))
    stats = rl.history_stats(parts)
    history = parts.where("part = 'history'")
    chunks, samples = rl.chunk_means(history, size=bins), rl.chunk_samples(history, size=bins) if compat else None
    if points is not None:
        edges, stats, chunks, entries, delta = points.fan(edges), points.fan(cut(stats)), points.fan(cut(chunks)), points.fan(entries), points.at("delta")
        samples = points.fan(cut(samples)) if compat else None
    w = gr.netmedic_edge_weight(edges, stats, chunks, samples, delta=delta)
    impact = full_impact(best_impacts(w, max_len), stats.select("incident_id", "service_id"))
    ab = stats.select("incident_id", "service_id", F.coalesce(abnormality(F.col("cur"), F.col("mean"), F.col("std")), F.lit(0.0)).alias("abnormality"))
    scores = gr.netmedic_rank(impact, rl.global_impact(impact, ab), entries)
    return rl.rank_services(scores, ["incident_id"], ascending=True)


def diagnose_tbac(metrics: DataFrame, entries: DataFrame, edges: DataFrame, prepared: bool = False) -> DataFrame:
    corr = rl.entry_correlation(ready(metrics, prepared), entries)
    return rl.rank_services(gr.tbac_rating(corr, *gr.reach_both(edges)), ["incident_id"])


def diagnose_microcause(metrics: DataFrame, entries: DataFrame, rho: float = 0.2, lam: float = 0.5, tau_max: int = 10, steps: int = 50, partial: bool = False, prepared: bool = False, points: Points | None = None) -> DataFrame:
    """``points`` have a rho and a lam each."""
    filled = metrics if prepared else pp.fill_zeros(metrics)
    eta = rl.eta_scores(run_spot(filled, q=1e-3, depth=10))
    links = cz.lagged_links(filled, tau_max)
    edges = cut(links.select("incident_id", F.col("effect").alias("src"), F.col("parent").alias("dst")).where("src <> dst").distinct().withColumn("weight", F.lit(1.0)))
    corr = cz.partial_correlations(rl.pearson_matrix(filled), entries, rl.confounders(edges, entries)) if partial else rl.entry_correlation(filled, entries)
    if points is not None:
        edges, corr, eta, entries, rho, lam = points.fan(edges), points.fan(cut(corr)), points.fan(cut(eta)), points.fan(entries), points.at("rho"), points.at("lam")
    q = gr.microcause_q(edges, corr, entries, rho, selves=not partial, flip=partial)
    v = gr.expected_visits(q, entries, steps)
    return rl.rank_services(gr.gamma_scores(v, eta, lam), ["incident_id"], digits=WALK_DIGITS)


#: Every method, and whether it takes a call graph.
METHODS = {
    "dynamic_causality": (diagnose_dynamic_causality, False),
    "monitor_rank": (diagnose_monitor_rank, True),
    "cloud_ranger": (diagnose_cloud_ranger, True),
    "netmedic": (diagnose_netmedic, True),
    "tbac": (diagnose_tbac, True),
    "microcause": (diagnose_microcause, False),
}

#: Parameters that late stages take as a column, so that a plan serves any number of their values.
LATE = {
    "dynamic_causality": ("sig", "ratio"),
    "monitor_rank": ("rho",),
    "cloud_ranger": ("beta", "rho"),
    "netmedic": ("delta",),
    "tbac": (),
    "microcause": ("rho", "lam"),
}


def diagnose(method: str, metrics: DataFrame, entries: DataFrame, edges: DataFrame | None = None, **params) -> DataFrame:
    """(incident_id, service_id, score, rank) by ``method``; a call graph is used where the method takes one."""
    run, graph = METHODS[method]
    ranked = run(metrics, entries, edges, **params) if graph else run(metrics, entries, **params)
    return ranked.select("incident_id", "service_id", "score", "rank")


def evaluate(ranking: DataFrame, truth: DataFrame, services: int | DataFrame, keys: tuple[str, ...] = ("incident_id",)) -> DataFrame:
    """prks, pr_avg and acc of each ranking."""
    return rl.pr_stat(ranking, truth, keys=keys).join(rl.rank_score(ranking, truth, services, keys), list(keys))


def evaluated(ranking: DataFrame, truth: DataFrame, services: DataFrame) -> DataFrame:
    """A ranking with the prks, pr_avg and acc of its incident; they are null where no cause is known."""
    ranking = cut(ranking)
    return ranking.join(evaluate(ranking, truth, services), "incident_id", "left")


#: Windows are incidents of their own while they are ranked; this parts the names.
BAR = "|"


def _windows(prepared: DataFrame, center: int, lens: list[int]) -> DataFrame:
    """The samples of all centred windows, each an incident of its own whose t starts at 0."""
    w = pp.centred_windows(prepared, center, lens)
    first = F.min("t").over(Window.partitionBy("incident_id", "window_start", "window_len"))
    runs = w.withColumn("t", F.col("t") - first).withColumn("incident_id", F.concat_ws(BAR, "incident_id", "window_start", "window_len"))
    return cut(runs.select("incident_id", "service_id", "t", "value"))


def _of_window(results: DataFrame) -> DataFrame:
    part = F.split("incident_id", r"\|")
    rest = [c for c in results.columns if c != "incident_id"]
    return results.select(part[0].alias("incident_id"), part[1].cast("long").alias("window_start"), part[2].cast("long").alias("window_len"), *rest)


def sweep_windows(metrics: DataFrame, entries: DataFrame, truth: DataFrame, edges: DataFrame | None, center: int, lens: list[int], grid: dict[str, list[dict]], graphs: list[tuple[int, float]] = ((1, 0.1),)) -> DataFrame:
    """Results (incident_id, window_start, window_len, method, params_id, prks, pr_avg, acc) of methods over windows and parameters.

    ``grid`` has, for each method, its parameter sets.  Series are prepared once, as a whole; the windows of all
    incidents are cut from them once and ranked together.  Without
    ``edges`` each window has dependency graphs of its own, one for each (samples summed before the tests, significance) of ``graphs``: all
    methods that take a graph read them, results have pc_aggregate and pc_alpha (null for the other methods) as well, and ``time``, the seconds
    of a method's job by window and parameter set and, as ``attach_graph_time`` adds them, of its graphs' job by window.
    """
    runs = _windows(prepare(metrics), center, lens)
    keys = cut(runs.select("incident_id").distinct().withColumn("_i", F.substring_index("incident_id", BAR, 1)))
    spread = lambda d: cut(d.withColumnRenamed("incident_id", "_i").join(keys, "_i").drop("_i"))
    entries, truth = spread(entries), spread(truth)
    if edges is not None:
        return _of_window(sweep_params(runs, entries, truth, spread(edges), grid, prepared=True))
    count, out, times = max(1, keys.count()), [], []
    windows = _of_window(keys.select("incident_id")).select("window_start", "window_len").distinct()
    plain = {m: sets for m, sets in grid.items() if not METHODS[m][1]}
    for bucket, alpha in (*graphs, (None, None)):
        some = plain if bucket is None else {m: sets for m, sets in grid.items() if METHODS[m][1]}
        began, graph = time.perf_counter(), None
        if bucket is not None and some:
            graph = cut(dependency_graph(runs, alpha, bucket, prepared=True))
        took = (time.perf_counter() - began) / count
        mark = {"pc_aggregate": F.lit(bucket).cast("int"), "pc_alpha": F.lit(alpha).cast("double")}
        times.append(windows.withColumns(mark | {"pc_time": F.lit(took)}))
        for method, sets in some.items():
            began = time.perf_counter()
            done = cut(_of_window(sweep_params(runs, entries, truth, graph, {method: sets}, prepared=True)))
            out.append(done.withColumns(mark | {"time": F.lit((time.perf_counter() - began) / (count * len(sets)))}))
    results = reduce(DataFrame.unionByName, out)
    return rl.attach_graph_time(results, reduce(DataFrame.unionByName, times))


def sweep_reports(results: DataFrame) -> dict[str, DataFrame]:
    """What a timed sweep of windows comes to: five best of each window, best by length, run times, best parameters, means by significance."""
    results = cut(append_results(results))
    return {
        "top5": rl.top5_summary(results),
        "max_by_length": rl.max_by_length(results),
        "runtime_by_length": rl.runtime_by_length(results),
        "best_params": best_of_sweep(results),
        "mean_by_significance": rl.mean_by_significance(results, ["method", "pc_alpha"]),
    }


def _plans(method: str, sets: list[dict]) -> list[tuple[dict, list[dict], list[str]]]:
    """Parameter sets that differ in late parameters only, together: (the others, the late ones, the sets' names)."""
    default = {k: p.default for k, p in inspect.signature(METHODS[method][0]).parameters.items()}
    together = defaultdict(list)
    for params in sets:
        late = [k for k in LATE[method] if k != "sig" or not (params.get("adf") or params.get("store"))]
        early = {k: v for k, v in params.items() if k not in late}
        points = {k: params.get(k, early.get(k, default[k])) for k in LATE[method]}
        name = ",".join(f"{k}={v}" for k, v in sorted(params.items()))
        together[repr(sorted(early.items()))].append((early, points, name))
    return [(g[0][0], [p for _, p, _ in g], [n for _, _, n in g]) for g in together.values()]


def sweep_params(metrics: DataFrame, entries: DataFrame, truth: DataFrame, edges: DataFrame | None, grid: dict[str, list[dict]], prepared: bool = False) -> DataFrame:
    """Results (incident_id, method, params_id, prks, pr_avg, acc) of every parameter set of every method, from series that may be ``prepared`` already.

    Sets of a method that differ in the parameters of ``LATE`` only are one plan, whose early stages (preparation, tests, correlations,
    dependency graph) run once; other parameters (steps, bounds of windows, lengths) shape the plan, and each of their combinations has one.
    """
    metrics, entries, truth = metrics if prepared else cut(metrics), cut(entries), cut(truth)
    edges = cut(edges) if edges is not None else None
    services = cut(metrics.select("incident_id", "service_id").distinct())
    out = []
    for method, sets in grid.items():
        for early, late, names in _plans(method, sets):
            points = Points(late) if len(late) > 1 else None
            ranked = diagnose(method, metrics, entries, edges, prepared=prepared, **early, **({"points": points} if points else {k: v for k, v in late[0].items() if k not in early}))
            ranked = points.split(ranked, names) if points else ranked.withColumn("params_id", F.lit(names[0]))
            out.append(ranked.withColumn("method", F.lit(method)))
    return evaluate(cut(reduce(DataFrame.unionByName, out)), truth, services, ("incident_id", "method", "params_id"))


def best_of_sweep(results: DataFrame) -> DataFrame:
    """Of each window and method (or incident and method) the parameters of the best accuracy."""
    return rl.best_params(append_results(results), [c for c in ("incident_id", "window_start", "window_len", "method") if c in results.columns])


def compare_thresholds(strength: DataFrame, local: DataFrame, entries: DataFrame, truth: DataFrame, ratios: list[float], levels: list[float], max_len: int = 4) -> DataFrame:
    """Results (incident_id, params_id, prks, pr_avg, acc) of adaptive and of static edge thresholds, from one set of strengths."""
    names = [f"adaptive={x}" for x in ratios] + [f"static={x}" for x in levels]
    if not names:
        raise ValueError("no threshold is given")
    points = Points([{"ratio": x, "level": None} for x in ratios] + [{"ratio": None, "level": x} for x in levels])
    services = local.select("incident_id", "service_id").distinct()
    every, corr, entries = points.fan(cut(strength)), points.fan(cut(rl.entry_correlation(local, entries))), points.fan(cut(entries))
    kept = wn.adaptive_threshold(every, points.at("ratio")).unionByName(wn.static_threshold(every, points.at("level")))
    paths = gr.best_paths(wn.normalize(kept, "dst"), entries, max_len, 50)
    ranked = points.split(rl.rank_services(gr.ranknode(paths, corr, 50, 1), ["incident_id"]), names)
    return evaluate(cut(ranked), truth, services, ("incident_id", "params_id"))
