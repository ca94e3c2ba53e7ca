"""Joins, aggregates, rankings and set operations."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spark_rca.operators.blocks import block_pairs
from spark_rca.operators.prepare import SERIES


def service_pairs(services: DataFrame) -> DataFrame:
    """All ordered pairs x <> y inside an incident."""
    a = services.select("incident_id", F.col("service_id").alias("x"))
    b = services.select("incident_id", F.col("service_id").alias("y"))
    return a.join(b, "incident_id").where("x <> y")


def pair_series(metrics: DataFrame) -> DataFrame:
    """(incident_id, x, y, t, vx, vy) of all ordered pairs; for few services, since rows grow with their square."""
    a = metrics.select("incident_id", "t", F.col("service_id").alias("x"), F.col("value").alias("vx"))
    b = metrics.select("incident_id", "t", F.col("service_id").alias("y"), F.col("value").alias("vy"))
    return a.join(b, ["incident_id", "t"]).where("x <> y")


def overlay_intervals(intervals: DataFrame, lengths: DataFrame) -> DataFrame:
    """Dynamic causality curves: for each pair the number of intervals over every t of 0..n-1.

    Starts add one and ends take one away; a running sum over the dense grid replaces the range join,
    so rows don't grow with the intervals' lengths.
    """
    key = ["incident_id", "x", "y"]
    steps = intervals.select(*key, F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d")))).alias("s")).select(*key, "s.t", "s.d")
    steps = steps.groupBy(*key, "t").agg(F.sum("d").alias("d"))
    grid = intervals.select(*key).distinct().join(lengths, "incident_id").select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("t"))
    run = Window.partitionBy(*key).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(steps, [*key, "t"], "left").withColumn("cnt", F.sum(F.coalesce("d", F.lit(0))).over(run)).drop("d")


def param_grid(spark: SparkSession, valid: str = "true", **values: list) -> DataFrame:
    """Product of small parameter lists, filtered, with an id for each set in the order of the lists."""
    frames = [spark.createDataFrame([(v,) for v in vs], [k]) for k, vs in values.items()]
    grid = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames).where(valid)
    return grid.withColumn("params_id", F.concat_ws("-", *values))


def attach_graph_time(results: DataFrame, times: DataFrame) -> DataFrame:
    """Adds the time of building the graph where it is known and over 0 (-1: it was cached)."""
    keys = ["window_start", "window_len", "pc_aggregate", "pc_alpha"]
    known = times.select(*[F.col(k).alias(f"_{k}") for k in keys], "pc_time")
    d = results.join(known, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])
    return d.withColumn("time", F.col("time") + F.when(F.col("pc_time") > 0, F.col("pc_time")).otherwise(0.0)).drop("pc_time")


def mark_true(ranking: DataFrame, truth: DataFrame) -> DataFrame:
    t = truth.select("incident_id", "service_id").distinct().withColumn("_t", F.lit(True))
    return ranking.join(t, ["incident_id", "service_id"], "left").withColumn("is_true", F.coalesce("_t", F.lit(False))).drop("_t")


def add_backward_edges(edges: DataFrame, weight: Column | None = None) -> DataFrame:
    """For each edge without its reverse, the reverse (by default of the same weight)."""
    back = edges.select("incident_id", F.col("dst").alias("src"), F.col("src").alias("dst"), (weight if weight is not None else F.col("weight")).alias("weight"))
    new = back.join(edges.select("incident_id", "src", "dst"), ["incident_id", "src", "dst"], "left_anti")
    return edges.select("incident_id", "src", "dst", "weight").unionByName(new)


def second_order_states(edges: DataFrame) -> DataFrame:
    """(prev, cur, next) of every two edges in a row."""
    a = edges.select("incident_id", F.col("src").alias("prev"), F.col("dst").alias("cur"), F.col("weight").alias("w1"))
    b = edges.select("incident_id", F.col("src").alias("cur"), F.col("dst").alias("next"), F.col("weight").alias("w2"))
    return a.join(b, ["incident_id", "cur"])


def graph_diff(g1: DataFrame, g2: DataFrame) -> DataFrame:
    d = g1.join(g2.withColumnRenamed("weight", "_w"), ["incident_id", "src", "dst"], "left")
    return d.select("incident_id", "src", "dst", (F.col("weight") - F.col("_w")).alias("diff"))


def restrict_to_path_edges(edges: DataFrame, used: DataFrame, min_weight: float) -> DataFrame:
    return edges.where(F.col("weight") > min_weight).join(used, ["incident_id", "src", "dst"], "left_semi")


def keep_valid_windows(results: DataFrame, windows: DataFrame) -> DataFrame:
    return results.join(windows, ["window_start", "window_len"], "left_semi")


# Aggregates


def pearson_matrix(metrics: DataFrame, zero_diag: bool = True, block: int = 32) -> DataFrame:
    """(incident_id, x, y, corr) of every two services over the t that both have; the diagonal is 0 or 1.

    A pair without two shared samples, or with one series constant there, has NULL; of samples that repeat a t one counts, and NaN and
    NULL are no samples.  Series are packed and dealt in pairs of blocks of ``block`` services, whose sums over shared
    samples are six matrix products: a sample is sent once per block, and a task holds two blocks.
    """
    packed = metrics.where("value IS NOT NULL AND NOT isnan(value)").groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("s"))
    packed = packed.select(*SERIES, F.col("s.t").alias("ts"), F.col("s.value").alias("vs"))

    def products(key, pdf):
        at = np.unique(np.concatenate(pdf["ts"].tolist()))
        v, on = np.zeros((len(pdf), len(at))), np.zeros((len(pdf), len(at)))
        for k, (t, x) in enumerate(zip(pdf["ts"], pdf["vs"], strict=True)):
            place, x = np.searchsorted(at, t), np.asarray(x, float)
            v[k, place], on[k, place] = x - x.mean() if np.ptp(x) else 0.0, 1.0
        b, ids = pdf["_b"].to_numpy(), pdf["service_id"].to_numpy()
        i, j = np.flatnonzero(b == key[1]), np.flatnonzero(b == key[2])
        vi, vj, oi, oj = v[i], v[j].T, on[i], on[j].T
        n, sx, sy = oi @ oj, vi @ oj, oi @ vj
        sxx, syy = (vi * vi) @ oj, oi @ (vj * vj)
        with np.errstate(divide="ignore", invalid="ignore"):
            qx, qy = sxx - sx * sx / n, syy - sy * sy / n
            fine = (n > 1) & (qx > 1e-12 * sxx) & (qy > 1e-12 * syy)
            corr = np.where(fine, np.clip((vi @ vj - sx * sy / n) / np.sqrt(qx * qy), -1, 1), np.nan)
        if key[1] == key[2]:
            np.fill_diagonal(corr, 0.0 if zero_diag else 1.0)
        x, y, c = np.repeat(ids[i], len(j)), np.tile(ids[j], len(i)), corr.ravel()
        if key[1] < key[2]:
            x, y, c = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([c, c])
        return pd.DataFrame({"incident_id": key[0], "x": x, "y": y, "corr": c})

    dealt = block_pairs(packed, packed.select(*SERIES), block)
    return dealt.groupBy("incident_id", "_p", "_q").applyInPandas(products, "incident_id string, x int, y int, corr double")


def entry_correlation(metrics: DataFrame, entries: DataFrame) -> DataFrame:
    """|corr| of each service with its incident's entry service; the entry's own is 1."""
    e = metrics.join(entries, ["incident_id", "service_id"]).select("incident_id", "t", F.col("value").alias("_e"))
    return metrics.join(e, ["incident_id", "t"]).groupBy(*SERIES).agg(F.abs(F.corr("value", "_e")).alias("corr"))


def edge_strength(intervals: DataFrame, pairs: DataFrame) -> DataFrame:
    """Total length of each pair's accepted intervals, the area under its curve; 0 if none."""
    s = intervals.groupBy("incident_id", "x", "y").agg(F.sum(F.col("end") - F.col("start")).cast("double").alias("weight"))
    d = pairs.join(s, ["incident_id", "x", "y"], "left")
    return d.select("incident_id", F.col("x").alias("src"), F.col("y").alias("dst"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


def anomaly_score(stds: DataFrame, limit: float = 1.0) -> DataFrame:
    return stds.groupBy("incident_id", "t").agg(F.count_if(F.col("std") > limit).alias("score"))


def path_node_counts(paths: DataFrame, last: int) -> DataFrame:
    """Occurrences of nodes among the last ``last`` of each path, without the entry."""
    tail = F.slice("path", F.greatest(F.lit(1), F.size("path") - last + 1), F.lit(last))
    return paths.select("incident_id", "entry", F.explode(tail).alias("service_id")).where("service_id <> entry").groupBy("incident_id", "service_id").agg(F.count("*").alias("cnt"))


def eta_scores(thresholds: DataFrame) -> DataFrame:
    """Per series: the largest |v - thr| / thr of points over the threshold (else 0) and the first such offset (0 if none)."""
    over = F.col("value") > F.col("upper")
    return thresholds.groupBy(*SERIES).agg(
        F.coalesce(F.max(F.when(over, F.abs(F.col("value") - F.col("upper")) / F.abs("upper"))), F.lit(0.0)).alias("eta"),
        F.coalesce(F.min(F.when(over, F.col("t"))), F.lit(0).cast("long")).alias("first_t"),
    )


def history_stats(parts: DataFrame) -> DataFrame:
    """Mean and population deviation of the history, mean of the current part, range of both."""
    h, c = F.when(F.col("part") == "history", F.col("value")), F.when(F.col("part") == "current", F.col("value"))
    return parts.groupBy(*SERIES).agg(F.avg(h).alias("mean"), F.stddev_pop(h).alias("std"), F.avg(c).alias("cur"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def chunk_means(history: DataFrame, k: int | None = None, size: int = 100, most: int = 50) -> DataFrame:
    """Means of k chunks of floor(H / k) samples; chunk 0 is the newest.  Without ``k``, an incident has floor(H / size), 1 to ``most``."""
    d = _with_chunks(history, k, size, most)
    c = F.floor((F.col("_H") - 1 - F.col("t")) / F.floor(F.col("_H") / F.col("_k")))
    return d.withColumn("chunk", c.cast("int")).where(F.col("chunk") < F.col("_k")).groupBy(*SERIES, "chunk").agg(F.avg("value").alias("mean"))


def chunk_samples(history: DataFrame, k: int | None = None, size: int = 100, most: int = 50) -> DataFrame:
    """The first k raw samples of each history in place of its chunk means."""
    d = _with_chunks(history, k, size, most)
    return d.where(F.col("t") < F.col("_k")).select(*SERIES, F.col("t").cast("int").alias("chunk"), F.col("value").alias("mean"))


def _with_chunks(history: DataFrame, k: int | None, size: int, most: int) -> DataFrame:
    d = history.withColumn("_H", F.max("t").over(Window.partitionBy("incident_id")) + 1)
    return d.withColumn("_k", F.lit(k) if k else F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col("_H") / size))))


def covered_fraction(curves: DataFrame) -> DataFrame:
    return curves.groupBy("incident_id", "x", "y").agg((F.count_if(F.col("cnt") > 0) / F.count("*")).alias("covered"))


def power_mean(scored: DataFrame, keys: list[str], p: float = 1.0) -> DataFrame:
    """Weighted power mean with sign-preserving powers, of score and w."""
    f = lambda x, e: F.signum(x) * F.pow(F.abs(x), F.lit(e))
    inner = F.sum(F.col("w") * f(F.col("score"), p)) / F.sum("w")
    return scored.groupBy(*keys).agg(f(inner, 1.0 / p).alias("mean"))


def average_rounds(results: DataFrame, keys: list[str]) -> DataFrame:
    """Mean PR@k vector (as k rows folded back to an array), PR@Avg and accuracy across rounds."""
    each = results.select(*keys, "acc", F.posexplode("prks").alias("k", "pr")).groupBy(*keys, "k").agg(F.avg("pr").alias("pr"), F.avg("acc").alias("acc"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "pr"))), lambda s: s["pr"]).alias("prks"), F.avg("pr").alias("pr_avg"), F.first("acc").alias("acc"))


def max_by_length(results: DataFrame) -> DataFrame:
    return results.groupBy("method", "window_len").agg(F.max("pr_avg").alias("pr_avg"), F.max("acc").alias("acc"))


def runtime_by_length(results: DataFrame, fixed: str = "window_start") -> DataFrame:
    """Mean time per length where the other parameter is 0."""
    return results.where(F.col(fixed) == 0).groupBy("method", "window_len").agg(F.avg("time").alias("time"))


def best_params(results: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("acc"), "params_id")
    return results.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def mean_by_significance(results: DataFrame, keys: list[str]) -> DataFrame:
    return results.groupBy(*keys).agg(F.avg("pr_avg").alias("pr_avg"), F.avg("acc").alias("acc"))


def sweep_summary(results: DataFrame) -> DataFrame:
    """Maximum, mean accuracy and time over method and length in one grouping-sets pass."""
    return results.cube("method", "window_len").agg(F.max("acc").alias("max_acc"), F.avg("acc").alias("avg_acc"), F.count("*").alias("n"))


def global_impact(impact: DataFrame, abnormality: DataFrame) -> DataFrame:
    """Sum over e of impact[c, e] * abnormality[e]."""
    a = abnormality.select("incident_id", F.col("service_id").alias("e"), "abnormality")
    return impact.join(a, ["incident_id", "e"]).groupBy("incident_id", F.col("c").alias("service_id")).agg(F.sum(F.col("impact") * F.col("abnormality")).alias("impact"))


# Rankings and limits


def anomaly_start(scores: DataFrame, services: DataFrame, proportion: float = 0.0) -> DataFrame:
    """The t of the highest score among those of at least N * proportion; in a tie the latest."""
    n = services.groupBy("incident_id").agg(F.count_distinct("service_id").alias("_n"))
    ok = scores.join(n, "incident_id").where(F.col("score") >= F.col("_n") * proportion)
    return ok.groupBy("incident_id").agg(F.max(F.struct("score", "t")).alias("m")).select("incident_id", F.col("m.t").alias("t"), F.col("m.score").alias("score"))


def order_intervals(intervals: DataFrame) -> DataFrame:
    w = Window.partitionBy("incident_id", "x", "y").orderBy("p_yx", F.desc("p_xy"), "start", "end")
    return intervals.withColumn("pos", F.row_number().over(w))


def top_paths(paths: DataFrame, k: int, least: float) -> DataFrame:
    """The k most probable paths of an incident, up to and with the first under ``least``; ties: shorter, then by nodes."""
    w = Window.partitionBy("incident_id").orderBy(F.desc_nulls_last("prob"), F.size("path"), "path")
    d = paths.withColumn("pos", F.row_number().over(w))
    under = F.sum(F.when(F.col("prob") < least, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return d.withColumn("_u", F.coalesce(under, F.lit(0))).where((F.col("pos") <= k) & (F.col("_u") == 0)).drop("_u")


def rank_services(scores: DataFrame, keys: list[str], ascending: bool = False, digits: int | None = None) -> DataFrame:
    """Ranks by score, then by service; with ``digits`` scores that are equal to so many decimals tie, whatever order their terms were added in."""
    s = F.col("score") if digits is None else F.round("score", digits)
    o = s.asc_nulls_last() if ascending else s.desc_nulls_last()
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(o, "service_id")))


def top5_summary(results: DataFrame) -> DataFrame:
    """Mean, population deviation and maximum of the five best accuracies of each window, and their mean time."""
    w = Window.partitionBy("method", "window_start", "window_len").orderBy(F.desc("acc"), "time", "params_id")
    top = results.withColumn("_r", F.row_number().over(w)).where("_r <= 5")
    return top.groupBy("method", "window_start", "window_len").agg(F.avg("acc").alias("acc_mean"), F.stddev_pop("acc").alias("acc_std"), F.max("acc").alias("acc_max"), F.avg("time").alias("time_mean"))


# Set operations


def path_edges(paths: DataFrame) -> DataFrame:
    """Distinct (src, dst) on the reversed paths: causes point to effects."""
    n = F.size("path")
    steps = F.arrays_zip(F.slice("path", F.lit(2), n - 1).alias("src"), F.slice("path", F.lit(1), n - 1).alias("dst"))
    return paths.where(n > 1).select("incident_id", F.explode(steps).alias("e")).select("incident_id", F.col("e.src").alias("src"), F.col("e.dst").alias("dst")).distinct()


def compare_edges(found: DataFrame, truth: DataFrame) -> DataFrame:
    cols = ["incident_id", "src", "dst"]
    f, t = found.select(cols), truth.select(cols)
    return f.intersect(t).withColumn("kind", F.lit("correct")).unionByName(t.subtract(f).withColumn("kind", F.lit("missing"))).unionByName(f.subtract(t).withColumn("kind", F.lit("extra")))


def confounders(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(incident_id, service_id, cond): parents of the entry and of the node, without the tested pair."""
    parents = edges.groupBy("incident_id", F.col("dst").alias("service_id")).agg(F.collect_set("src").alias("parents"))
    nodes = edges.select("incident_id", F.explode(F.array("src", "dst")).alias("service_id")).distinct()
    empty = F.array().cast("array<int>")
    own = nodes.join(parents, ["incident_id", "service_id"], "left").withColumn("parents", F.coalesce("parents", empty))
    entry = entries.withColumnRenamed("service_id", "entry").join(own.withColumnRenamed("service_id", "entry").withColumnRenamed("parents", "_ep"), ["incident_id", "entry"], "left")
    d = own.join(entry, "incident_id").where("service_id <> entry")
    cond = F.array_except(F.array_union(F.coalesce("_ep", empty), F.col("parents")), F.array("service_id", "entry"))
    return d.select("incident_id", "service_id", F.array_sort(cond).alias("cond"))


def result_labels(results: DataFrame, method: str) -> DataFrame:
    return results.where(F.col("method") == method).select("window_start", "window_len").distinct()


# Evaluation


def precision_at_k(ranking: DataFrame, truth: DataFrame, k: int, keys: tuple[str, ...] = ("incident_id",)) -> DataFrame:
    """Hits in the first k over min(number of true causes, k)."""
    n = truth.groupBy("incident_id").agg(F.count_distinct("service_id").alias("_n"))
    m = mark_true(ranking, truth).groupBy(*keys).agg(F.count_if(F.col("is_true") & (F.col("rank") <= k)).alias("_h"))
    return m.join(n, "incident_id").select(*keys, (F.col("_h") / F.least(F.col("_n"), F.lit(k))).alias("pr"))


def pr_stat(ranking: DataFrame, truth: DataFrame, k: int = 5, keys: tuple[str, ...] = ("incident_id",)) -> DataFrame:
    """PR@1..k as an array, and their mean."""
    n = truth.groupBy("incident_id").agg(F.count_distinct("service_id").alias("_n"))
    hits = [F.count_if(F.col("is_true") & (F.col("rank") <= i)).alias(f"_h{i}") for i in range(1, k + 1)]
    m = mark_true(ranking, truth).groupBy(*keys).agg(*hits).join(n, "incident_id")
    prs = [F.col(f"_h{i}") / F.least(F.col("_n"), F.lit(i)) for i in range(1, k + 1)]
    return m.select(*keys, F.array(*prs).alias("prks"), (sum(prs[1:], prs[0]) / k).alias("pr_avg"))


def rank_score(ranking: DataFrame, truth: DataFrame, n: int | DataFrame, keys: tuple[str, ...] = ("incident_id",)) -> DataFrame:
    """Mean over the true causes of (n - max(0, rank - number of true causes)) / n; unranked counts 0.

    ``n`` is one number of services or the services (incident_id, service_id) of each incident.
    """
    t = truth.select("incident_id", "service_id").distinct()
    size = t.groupBy("incident_id").agg(F.count("*").alias("_n"))
    runs = ranking.select(*keys).distinct().join(t, "incident_id").join(size, "incident_id")
    d = runs.join(ranking.select(*keys, "service_id", "rank"), [*keys, "service_id"], "left")
    if isinstance(n, DataFrame):
        d, n = d.join(n.groupBy("incident_id").agg(F.count_distinct("service_id").alias("_all")), "incident_id"), F.col("_all")
    else:
        n = F.lit(n)
    s = F.when(F.col("rank").isNull(), 0.0).otherwise((n - F.greatest(F.lit(0), F.col("rank") - F.col("_n"))) / n)
    return d.groupBy(*keys).agg(F.avg(s).alias("acc"))
