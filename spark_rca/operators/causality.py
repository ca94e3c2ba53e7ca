"""Causality tests: pairs are rows of packed series, spread by pair and tested with numpy in tasks."""

from __future__ import annotations

import math
from collections import namedtuple
from functools import reduce
from itertools import combinations, islice
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_rca.functions.numeric import adf_stack, fisher_p, gram_stats, granger_grams, granger_stats, lag_rows, partial_corr
from spark_rca.operators.blocks import block_pairs, spread
from spark_rca.operators.lineage import cut
from spark_rca.operators.prepare import SERIES
from spark_rca.operators.relate import service_pairs

TESTS = "incident_id string, x int, y int, seg_i int, seg_j int, start long, end long, p_yx double, p_xy double, adf_y double, adf_x double, accepted boolean"


def pack(metrics: DataFrame) -> DataFrame:
    """One row per series: t0 and its values in order.

    Tests compare samples by their t, so a series must have one sample at every t from its first to its
    last; one with holes or repeated samples is refused with an error.  (``metrics_from_events`` and ``bucket_sum`` give such grids.)
    """
    s = F.array_sort(F.collect_list(F.struct("t", "value")))
    p = metrics.groupBy(*SERIES).agg(F.min("t").alias("t0"), (F.max("t") - F.min("t") + 1).alias("_n"), s.alias("_s"))
    whole = (F.size("_s") == F.col("_n")) & (F.size(F.array_distinct(F.col("_s.t"))) == F.col("_n"))
    refused = F.raise_error(F.concat(F.lit("holes or repeated samples in series "), F.col("incident_id"), F.lit(" "), F.col("service_id").cast("string")))
    return p.select(*SERIES, "t0", F.when(whole, F.col("_s.value")).otherwise(refused.cast("array<double>")).alias("vals"))


def packed_pairs(metrics: DataFrame) -> DataFrame:
    """(incident_id, x, y, t0, vx, vy) for all ordered pairs, cut to the range of t that both series have: packed rows are joined, never samples.

    Pairs without a shared t are left out.  Dealt by pair, so that one large incident fills all tasks.
    """
    p = pack(metrics)
    pairs = service_pairs(p.select("incident_id", "service_id"))
    a = p.select("incident_id", F.col("service_id").alias("x"), F.col("t0").alias("_a"), F.col("vals").alias("vx"))
    b = p.select("incident_id", F.col("service_id").alias("y"), F.col("t0").alias("_b"), F.col("vals").alias("vy"))
    d = pairs.join(a, ["incident_id", "x"]).join(b, ["incident_id", "y"])
    d = d.withColumn("t0", F.greatest("_a", "_b")).withColumn("_n", F.least(F.col("_a") + F.size("vx"), F.col("_b") + F.size("vy")) - F.col("t0"))
    at = lambda v, own: F.slice(v, (F.col("t0") - F.col(own) + 1).cast("int"), F.col("_n").cast("int")).alias(v)
    return d.where("_n > 0").select("incident_id", "x", "y", "t0", at("vx", "_a"), at("vy", "_b")).transform(spread, "incident_id", "x", "y")


def splits(n: int, step: int) -> list[int]:
    k = n // step
    return [i * step for i in range(k)] + [n] if k else []


#: A pair of series to be tested: its row, numbers of segments and bounds of its intervals, both series scaled.
_Pair = namedtuple("_Pair", "row i j s e cx cy")

#: Intervals that are solved together, of one pair or of many short ones.
STACK = 4096


def granger_intervals(metrics: DataFrame, step: int, lag: int, sig: float = 0.1, min_len: int | None = None, max_len: int | None = None, adf: bool = False) -> DataFrame:
    """Tests y <- x on every interval of segments; x <- y where that is significant; optionally stationarity of both.

    Any interval's Gram matrix is a difference of prefix sums, so a pair costs one pass over its
    samples and its part of a stack of small solves.  p_xy is NULL where it was not tested.  With ``adf`` the test
    runs on y, then x, of one-way intervals, and a p-value over ``sig`` rejects.  An interval is
    accepted if p_yx < sig and p_xy is at least sig.
    """

    def tested(held):
        """The rows of some pairs, whose intervals are one stack of solves."""
        cuts = np.cumsum([len(h.s) for h in held])[:-1]
        length = np.concatenate([h.e - h.s for h in held])
        p_yx = gram_stats(np.concatenate([granger_grams(lag_rows(h.cy, h.cx, lag), h.s, h.e, lag) for h in held]), length, lag)[1]
        back, on = np.full(len(length), np.nan), p_yx < sig
        if on.any():
            some = [(h, o) for h, o in zip(held, np.split(on, cuts), strict=True) if o.any()]
            back[on] = gram_stats(np.concatenate([granger_grams(lag_rows(h.cx, h.cy, lag), h.s[o], h.e[o], lag) for h, o in some]), length[on], lag)[1]
        out = []
        for h, p, q in zip(held, np.split(p_yx, cuts), np.split(back, cuts), strict=True):
            r, ok = h.row, (p < sig) & (q >= sig)
            gate = np.full((2, len(p)), np.nan)
            done = np.zeros((2, len(p)), bool)
            for side, v in enumerate((r.vy, r.vx) if adf else ()):
                done[side] = ok
                gate[side, ok] = adf_stack(np.asarray(v, float)[: len(h.cx)], h.s[ok], h.e[ok], lag)
                ok &= ~done[side] | (gate[side] <= sig)
            for k in np.flatnonzero(~np.isnan(p)):
                ay, ax = (float(gate[side, k]) if done[side, k] else None for side in (0, 1))
                out.append((r.incident_id, r.x, r.y, int(h.i[k]), int(h.j[k]), int(r.t0 + h.s[k]), int(r.t0 + h.e[k]), float(p[k]), None if np.isnan(q[k]) else float(q[k]), ay, ax, bool(ok[k])))
        return out

    def run(it):
        for pdf in it:
            out, held, size = [], [], 0
            for r in pdf.itertuples(index=False):
                vx, vy = np.asarray(r.vx, float), np.asarray(r.vy, float)
                n = min(len(vx), len(vy))
                at = splits(n, step)
                ij = [(i, j) for i in range(len(at)) for j in range(i + 1, len(at)) if (min_len or step) <= at[j] - at[i] <= (max_len or n)]
                if not ij or n <= 3 * lag + 1:
                    continue
                i, j = np.array(ij).T
                cx, cy = (v[:n] - v[:n].mean() for v in (vx, vy))
                held.append(_Pair(r, i, j, np.array(at)[i], np.array(at)[j], cx / (cx.std() or 1), cy / (cy.std() or 1)))
                size += len(i)
                if size >= STACK:
                    out += tested(held)
                    held, size = [], 0
            if held:
                out += tested(held)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in TESTS.split(", ")])

    return packed_pairs(metrics).mapInPandas(run, TESTS)


def accept_intervals(tests: DataFrame, sig: float) -> DataFrame:
    """Intervals where x drives y one way: p_yx < sig and p_xy at least sig or untested."""
    return tests.where((F.col("p_yx") < sig) & (F.col("p_xy").isNull() | (F.col("p_xy") >= sig)))


def granger_f(pairs: DataFrame, lag: int) -> DataFrame:
    """F and p of y <- x over whole series; ``pairs`` as from ``packed_pairs``."""

    def run(it):
        for pdf in it:
            out = []
            for r in pdf.itertuples(index=False):
                vx, vy = np.asarray(r.vx, float), np.asarray(r.vy, float)
                n = len(vy)
                f, p = (float(a[0]) for a in granger_stats(lag_rows(vy - vy.mean(), vx - vx.mean(), lag), np.array([0]), np.array([n]), lag)) if n > 3 * lag + 1 else (np.nan, np.nan)
                out.append((r.incident_id, r.x, r.y, f, p))
            yield pd.DataFrame(out, columns=["incident_id", "x", "y", "f", "p"])

    return pairs.mapInPandas(run, "incident_id string, x int, y int, f double, p double")


def granger_lag1(pair_rows: DataFrame) -> DataFrame:
    """F statistic of y <- x with one lag, from sums of products only (rows as from ``lag_matrix`` with lag 1)."""
    c = lambda a, b: F.covar_pop(a, b)
    g = pair_rows.groupBy("incident_id", "x", "y").agg(
        c("y0", "y0").alias("syy"), c("y1", "y1").alias("saa"), c("x1", "x1").alias("sbb"), c("y1", "x1").alias("sab"), c("y0", "y1").alias("sya"), c("y0", "x1").alias("syb"), F.count("*").alias("n")
    )
    det = F.col("saa") * F.col("sbb") - F.col("sab") * F.col("sab")
    r = F.col("syy") - F.col("sya") * F.col("sya") / F.when(F.col("saa") > 0, F.col("saa"))
    gain = F.col("sya") * F.col("sya") * F.col("sbb") - 2 * F.col("sya") * F.col("syb") * F.col("sab") + F.col("syb") * F.col("syb") * F.col("saa")
    u = F.col("syy") - gain / F.when(det > 1e-9, det)
    return g.select("incident_id", "x", "y", ((r - u) / u * (F.col("n") - 3)).alias("f"))


def granger_full_graph(metrics: DataFrame, lag: int, sig: float) -> DataFrame:
    """Edge x -> y of weight 1 - p where x helps to predict y over the whole window."""
    p = granger_f(packed_pairs(metrics), lag)
    return p.where(F.col("p") < sig).select("incident_id", F.col("x").alias("src"), F.col("y").alias("dst"), (1 - F.col("p")).alias("weight"))


def adf_pvalues(metrics: DataFrame, max_lag: int | None = None) -> DataFrame:
    def run(it):
        for pdf in it:
            yield pd.DataFrame({"incident_id": pdf["incident_id"], "service_id": pdf["service_id"], "p": [float(adf_stack(np.asarray(v, float), np.array([0]), np.array([len(v)]), max_lag)[0]) for v in pdf["vals"]]})

    return pack(metrics).mapInPandas(run, "incident_id string, service_id int, p double")


def gate_stationary(tests: DataFrame, sig: float) -> DataFrame:
    """Accepted intervals whose two series pass the stationarity test: NULL counts as not run, over ``sig`` rejects."""
    ok = (F.coalesce(F.col("adf_y"), F.lit(0.0)) <= sig) & (F.coalesce(F.col("adf_x"), F.lit(0.0)) <= sig)
    return accept_intervals(tests, sig).where(ok)


def granger_verdict(metrics: DataFrame, lag: int, sig: float = 0.05) -> DataFrame:
    """For x < y: not stationary, x causes y, y causes x, both, or none."""
    p = granger_f(packed_pairs(metrics), lag)
    a = adf_pvalues(metrics, lag)
    st = a.select("incident_id", F.col("service_id").alias("x"), F.col("p").alias("ax"))
    d = p.where("x < y").join(p.select("incident_id", F.col("y").alias("x"), F.col("x").alias("y"), F.col("p").alias("q")), ["incident_id", "x", "y"])
    d = d.join(st, ["incident_id", "x"]).join(st.select("incident_id", F.col("x").alias("y"), F.col("ax").alias("ay")), ["incident_id", "y"])
    v = (
        F.when((F.col("ax") > sig) | (F.col("ay") > sig) | F.isnan("ax") | F.isnan("ay"), "not stationary")
        .when((F.col("p") < sig) & (F.col("q") < sig), "both")
        .when(F.col("p") < sig, "x causes y")
        .when(F.col("q") < sig, "y causes x")
        .otherwise("none")
    )
    return d.select("incident_id", "x", "y", v.alias("verdict"))


def _corr_rows(corr: DataFrame) -> DataFrame:
    return corr.groupBy("incident_id").agg(F.collect_list(F.struct("x", "y", "corr")).alias("c"))


def _square(cells) -> tuple[list[int], np.ndarray]:
    ids = sorted({c["x"] for c in cells})
    at = {s: k for k, s in enumerate(ids)}
    m = np.eye(len(ids))
    for c in cells:
        if c["x"] != c["y"]:
            m[at[c["x"]], at[c["y"]]] = c["corr"] if c["corr"] is not None and c["corr"] == c["corr"] else 0.0
    return ids, m


def _critical(alpha: float) -> float:
    """The z over which a two-sided test at ``alpha`` rejects."""
    return NormalDist().inv_cdf(1 - alpha / 2)


def _fisher_z(r: Column, n: Column, conds: int = 0) -> Column:
    r = F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0))
    return F.atanh(F.greatest(F.least(F.abs(r), F.lit(0.9999999)), F.lit(0.0))) * F.sqrt(F.greatest(n - conds - 3, F.lit(1)))


def _renewed(df: DataFrame) -> DataFrame:
    """``df`` with columns of its own, to be grouped with a table that it was joined from."""
    return df.select([F.col(c).alias(c) for c in df.columns])


SEPARATED = "incident_id string, src int, dst int, cond array<int>"


def _separate(work: DataFrame, corr: DataFrame, level: int, alpha: float, stack: int = 256) -> DataFrame:
    """The first set of ``level`` nodes in each row's range that separates its edge.

    ``work`` has (incident_id, src, part, dst, others, lo, hi): sets number lo to hi of ``others``.  The correlations of a src with its
    neighbours, and of these with each other, come by joins to each of its parts.
    """
    near = work.select("incident_id", "src", "part", F.explode(F.concat("others", F.array("src", "dst"))).alias("a")).distinct()
    cells = near.join(near.withColumnRenamed("a", "b"), ["incident_id", "src", "part"]).where("a < b").join(corr.select("incident_id", F.col("x").alias("a"), F.col("y").alias("b"), "corr"), ["incident_id", "a", "b"])
    limit = _critical(alpha)

    def test(key, todo, cells):
        ids = np.unique(np.concatenate([*todo["others"].tolist(), todo["src"], todo["dst"]]))
        m = np.eye(len(ids))
        i, j, c = np.searchsorted(ids, cells["a"]), np.searchsorted(ids, cells["b"]), np.nan_to_num(cells["corr"].to_numpy(float))
        m[i, j], m[j, i] = c, c
        out = []
        for r in todo.itertuples(index=False):
            others, ends = np.searchsorted(ids, r.others), np.searchsorted(ids, [r.src, r.dst])
            sets = islice(combinations(others.tolist(), level), r.lo, r.hi)
            while some := list(islice(sets, stack)):
                at = np.concatenate([np.tile(ends, (len(some), 1)), np.array(some, int)], axis=1)
                p = np.linalg.pinv(m[at[:, :, None], at[:, None, :]])
                d = p[:, 0, 0] * p[:, 1, 1]
                rho = np.where(d > 0, -p[:, 0, 1] / np.sqrt(np.where(d > 0, d, 1)), 0.0)
                z = np.arctanh(np.clip(np.abs(rho), 0, 0.9999999)) * np.sqrt(max(r.n - level - 3, 1))
                if (z < limit).any():
                    out.append((r.incident_id, r.src, r.dst, ids[at[np.flatnonzero(z < limit)[0], 2:]].tolist()))
                    break
        return pd.DataFrame(out, columns=[c.split()[0] for c in SEPARATED.split(", ")])

    keys = ["incident_id", "src", "part"]
    return spread(work, *keys).groupBy(*keys).cogroup(spread(_renewed(cells), *keys).groupBy(*keys)).applyInPandas(test, SEPARATED)


def _first_separating(m: np.ndarray, edges: list[tuple[int, int, list[int]]], level: int, n: int, limit: float, stack: int = 2048) -> dict[tuple[int, int], tuple[int, ...]]:
    """Of each edge (src, dst, others) the first set of ``level`` others that separates it; edges without one are left out."""
    found, live = {}, [(a, b, combinations(others, level)) for a, b, others in edges]
    while live:
        most = max(1, stack // len(live))
        some = [list(islice(sets, most)) for _, _, sets in live]
        at = np.array([(a, b, *c) for (a, b, _), cs in zip(live, some, strict=True) for c in cs], int)
        if not len(at):
            break
        p = np.linalg.pinv(m[at[:, :, None], at[:, None, :]])
        d = p[:, 0, 0] * p[:, 1, 1]
        rho = np.where(d > 0, -p[:, 0, 1] / np.sqrt(np.where(d > 0, d, 1)), 0.0)
        z = np.arctanh(np.clip(np.abs(rho), 0, 0.9999999)) * np.sqrt(max(n - level - 3, 1))
        rest = []
        for edge, cs, hit in zip(live, some, np.split(z < limit, np.cumsum([len(cs) for cs in some])[:-1]), strict=True):
            if hit.any():
                found[edge[:2]] = cs[int(np.argmax(hit))]
            elif len(cs) == most:
                rest.append(edge)
        live = rest
    return found


def _skeletons_of_incidents(first: DataFrame, alpha: float, max_level: int | None) -> DataFrame:
    """(incident_id, src, dst, cond) of incidents that are groups, all levels at once: edges that stay have no cond, separations src < dst."""
    limit = _critical(alpha)

    def run(key, pdf):
        ids = np.unique(np.concatenate([pdf["src"], pdf["dst"]]))
        i, j = np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"])
        m, up, c = np.eye(len(ids)), i < j, np.nan_to_num(pdf["corr"].to_numpy(float))
        m[i[up], j[up]] = m[j[up], i[up]] = c[up]
        near = np.zeros(m.shape, bool)
        near[i, j] = ~pdf["free"].to_numpy(bool)
        out, level = [], 1
        while max_level is None or level <= max_level:
            of = [np.flatnonzero(x).tolist() for x in near]
            edges = [(a, b, [x for x in of[a] if x != b]) for a in range(len(ids)) for b in of[a] if len(of[a]) > level]
            if not edges:
                break
            hit = _first_separating(m, edges, level, int(pdf["n"].iloc[0]), limit)
            for a, b in sorted({(min(e), max(e)) for e in hit}):
                cond = min(hit[e] for e in ((a, b), (b, a)) if e in hit)
                near[a, b] = near[b, a] = False
                out.append((*key, int(ids[a]), int(ids[b]), [int(ids[x]) for x in cond]))
            level += 1
        out += [(*key, int(ids[a]), int(ids[b]), None) for a, b in zip(*np.nonzero(near), strict=True)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in SEPARATED.split(", ")])

    return spread(first, "incident_id").groupBy("incident_id").applyInPandas(run, SEPARATED)


def pc_skeleton(corr: DataFrame, samples: int | DataFrame, alpha: float = 0.1, max_level: int | None = None, chunk: int = 4096, group: int = 16) -> tuple[DataFrame, DataFrame]:
    """(edges, separations) of the PC skeleton by Gaussian partial correlations.

    Edges are (incident_id, src, dst, weight 1), both ways; separations (incident_id, src, dst, cond), src < dst, have a set that each
    removed edge was removed by, of its first ones the least.  Stable version: a level tests every edge against the subsets of each end's
    neighbours at its start, so the order of tests does not matter.  Levels go on until no node has more neighbours than the
    level, or to ``max_level``.  An incident of up to ``group`` services is one group, with all its levels.  In larger ones a level is a join of edges with their subsets, dealt by source node and by ranges of ``chunk`` subsets: the first range
    of every edge, then the rest of those that are left.  Only edges and correlations are kept between levels.
    """
    rows = corr.where("x <> y")
    rows = rows.join(samples.select("incident_id", "n"), "incident_id") if isinstance(samples, DataFrame) else rows.withColumn("n", F.lit(samples))
    rows = cut(rows.select("incident_id", "x", "y", "corr", F.col("n").cast("long").alias("n")))
    free = _fisher_z(F.col("corr"), F.col("n")) < _critical(alpha)
    first = rows.select("incident_id", F.col("x").alias("src"), F.col("y").alias("dst"), "n", free.alias("free"), "corr")
    found = [first.where("free AND src < dst").select("incident_id", "src", "dst", F.array().cast("array<int>").alias("cond"))]
    many = rows.groupBy("incident_id").agg(F.count_distinct("x").alias("_k")).where(F.col("_k") > group).select("incident_id")
    some = bool(many.take(1))
    many = cut(many) if some else many
    done = cut(_skeletons_of_incidents(first.join(many, "incident_id", "left_anti") if some else first, alpha, max_level))
    few = done.where("cond IS NULL").select("incident_id", "src", "dst", F.lit(1.0).alias("weight"))
    found.append(done.where("cond IS NOT NULL"))
    if not some:
        return few, reduce(DataFrame.unionByName, found)
    rows = cut(rows.join(many, "incident_id", "left_semi"))
    edges = cut(first.join(many, "incident_id", "left_semi").where("NOT free").drop("free", "corr"))
    level = 1
    while max_level is None or level <= max_level:
        near = edges.groupBy("incident_id", "src").agg(F.array_sort(F.collect_set("dst")).alias("near"))
        work = edges.join(near, ["incident_id", "src"]).withColumn("others", F.array_remove("near", F.col("dst"))).where(F.size("others") >= level).drop("near")
        work = cut(work)
        if not work.take(1):
            break
        total = F.udf(lambda m: min(math.comb(m, level), 2**62), "long")(F.size("others"))
        work = work.withColumn("total", total)
        lost = None
        for wave in (0, 1):
            if wave:
                left = work.where(F.col("total") > chunk).join(lost.select("incident_id", "src", "dst"), ["incident_id", "src", "dst"], "left_anti")
                left = left.withColumn("lo", F.explode(F.sequence(F.lit(chunk).cast("long"), F.col("total") - 1, F.lit(chunk).cast("long"))))
                if not left.take(1):
                    break
            else:
                left = work.withColumn("lo", F.lit(0).cast("long"))
            todo = left.select("incident_id", "src", F.floor(F.col("lo") / chunk).alias("part"), "dst", "others", "n", "lo", F.least("total", F.col("lo") + chunk).alias("hi"))
            hit = cut(_separate(todo, rows, level, alpha))
            both = hit.select("incident_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "cond").groupBy("incident_id", "src", "dst").agg(F.min("cond").alias("cond"))
            pair = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
            gone = both.select("incident_id", pair.alias("e"), "cond").select("incident_id", "e.src", "e.dst", "cond")
            lost = cut(gone if lost is None else lost.unionByName(gone))
        found.append(lost.where("src < dst").groupBy("incident_id", "src", "dst").agg(F.min("cond").alias("cond")))
        edges = cut(edges.join(lost.select("incident_id", "src", "dst"), ["incident_id", "src", "dst"], "left_anti"))
        level += 1
    return few.unionByName(edges.select("incident_id", "src", "dst", F.lit(1.0).alias("weight"))), reduce(DataFrame.unionByName, found)


def pc_graph(corr: DataFrame, samples: int | DataFrame, alpha: float = 0.1, max_level: int | None = None) -> DataFrame:
    """The edges of ``pc_skeleton``; ``samples`` is one count or (incident_id, n)."""
    return pc_skeleton(corr, samples, alpha, max_level)[0]


def lagged_correlations(metrics: DataFrame, tau_max: int, block: int = 16) -> DataFrame:
    """(incident_id, x, y, n, r) of all ordered pairs, x itself included: r holds the correlation of x at lag a and y at lag b at place a * (2 tau_max + 1) + b.

    An incident's series are cut to the t that all of them have; n is what is left for lags of 0 to 2 tau_max, and without two there are
    no rows.  Holes are refused (see ``pack``); constant stretches correlate 0.  Dealt in pairs of blocks of services, so that one incident fills all tasks.
    """
    return _block_correlations(_shared_range(cut(pack(metrics)), tau_max), tau_max, block)


def _shared_range(packed: DataFrame, tau_max: int) -> DataFrame:
    """Packed series cut to the t that all of their incident have; incidents without two samples beyond the lags are left out."""
    shared = packed.groupBy("incident_id").agg(F.max("t0").alias("_lo"), F.min(F.col("t0") + F.size("vals")).alias("_hi"))
    p = packed.join(shared, "incident_id").where(F.col("_hi") - F.col("_lo") > 2 * tau_max + 1)
    return p.select(*SERIES, F.slice("vals", (F.col("_lo") - F.col("t0") + 1).cast("int"), (F.col("_hi") - F.col("_lo")).cast("int")).alias("vals"))


def _lagged(x: np.ndarray, tau_max: int) -> np.ndarray:
    """(series, lag, sample): each series at lags of 0 to 2 tau_max, centred and scaled to length 1; constant ones are 0."""
    x, lags = x.astype(float), 2 * tau_max + 1
    n = x.shape[1] - 2 * tau_max
    z = np.stack([x[:, 2 * tau_max - t : 2 * tau_max - t + n] for t in range(lags)], axis=1)
    z = z - z.mean(2, keepdims=True)
    size = np.sqrt((z * z).sum(2, keepdims=True))
    scale = np.abs(x).max(1)[:, None, None] * np.sqrt(n) * 1e-12
    return np.where(size > scale, z / np.where(size > scale, size, 1), 0.0)


def _block_correlations(series: DataFrame, tau_max: int, block: int) -> DataFrame:
    """``lagged_correlations`` of series (incident_id, service_id, vals) of one range in each incident."""
    lags = 2 * tau_max + 1

    def products(key, pdf):
        b, ids = pdf["_b"].to_numpy(), pdf["service_id"].to_numpy()
        z = _lagged(np.stack(pdf["vals"].tolist()), tau_max)
        n = z.shape[2]
        i, j = np.flatnonzero(b == key[1]), np.flatnonzero(b == key[2])
        r = (z[i].reshape(len(i) * lags, n) @ z[j].reshape(len(j) * lags, n).T).reshape(len(i), lags, len(j), lags).transpose(0, 2, 1, 3)
        rows = [(key[0], int(ids[a]), int(ids[c]), n, r[k, m].ravel()) for k, a in enumerate(i) for m, c in enumerate(j)]
        if key[1] < key[2]:
            rows += [(key[0], int(ids[c]), int(ids[a]), n, r[k, m].T.ravel()) for k, a in enumerate(i) for m, c in enumerate(j)]
        return pd.DataFrame(rows, columns=["incident_id", "x", "y", "n", "r"])

    dealt = spread(block_pairs(series, series.select(*SERIES), block), "incident_id", "_p", "_q")
    return dealt.groupBy("incident_id", "_p", "_q").applyInPandas(products, "incident_id string, x int, y int, n long, r array<double>")


def _among(need: DataFrame, corr: DataFrame) -> DataFrame:
    """The lagged correlations of every two of the services that a target needs (incident_id, target, service_id)."""
    a = need.select("incident_id", "target", F.col("service_id").alias("x"))
    b = need.select("incident_id", "target", F.col("service_id").alias("y"))
    return a.join(b, ["incident_id", "target"]).join(corr, ["incident_id", "x", "y"])


def _lag_matrix(pdf: pd.DataFrame, lags: int) -> tuple[list[int], np.ndarray]:
    """(services, matrix) of a target's rows; lag t of service number s is row t * services + s."""
    ids = sorted(set(pdf["x"]))
    k = len(ids)
    c = np.zeros((lags, k, lags, k))
    i, j = np.searchsorted(ids, pdf["x"]), np.searchsorted(ids, pdf["y"])
    for a, b, r in zip(i, j, pdf["r"], strict=True):
        c[:, a, :, b] = np.asarray(r).reshape(lags, lags)
    c = c.reshape(lags * k, lags * k)
    np.fill_diagonal(c, 1.0)
    return ids, c


def _thinned(c: np.ndarray, j: int, k: int, n: int, tau_max: int, pc_alpha: float, max_conds: int | None) -> list[int]:
    """The rows of ``c`` that stay candidates of target number ``j`` of ``k``, strongest first."""
    z = np.arctanh(np.minimum(np.abs(c[j]), 0.9999999)) * np.sqrt(max(n - 3, 1))
    # Those that correlate with the target too little go in the first round anyway.
    cand = [v for v in range(k, (tau_max + 1) * k) if z[v] > _critical(pc_alpha) - 1e-6]
    cand.sort(key=lambda v: -abs(c[j, v]))
    for size in range(len(cand) if max_conds is None else max_conds + 1):
        if len(cand) <= size:
            break
        for v in list(cand):
            others = [u for u in cand if u != v][:size]
            if len(others) == size and fisher_p(partial_corr(c, j, v, others), n, size) > pc_alpha:
                cand.remove(v)
    return cand


def _settled(c: np.ndarray, j: int, k: int, n: int, of: dict[int, list[int]], alpha_level: float, max_conds: int | None) -> list[tuple[int, int, float]]:
    """(number, lag, p) of the candidates ``of`` target number ``j`` that stay given its own and theirs."""
    out = []
    for v in of[j]:
        t, i = divmod(v, k)
        cond = [u for u in of[j] if u != v] + [u + t * k for u in of.get(i, [])[:max_conds]]
        cond = [u for u in dict.fromkeys(cond) if u not in (j, v)]
        p = fisher_p(partial_corr(c, j, v, cond), n, len(cond))
        if p < alpha_level:
            out.append((i, t, float(p)))
    return out


LINKS = "incident_id string, effect int, parent int, tau int, p double"


def _links_of_incidents(series: DataFrame, tau_max: int, pc_alpha: float, alpha_level: float, max_conds: int | None) -> DataFrame:
    """The links of incidents of one block: a group holds an incident's series and correlations, and only its links leave it."""
    lags = 2 * tau_max + 1

    def run(key, pdf):
        pdf = pdf.sort_values("service_id")
        ids, z = pdf["service_id"].tolist(), _lagged(np.stack(pdf["vals"].tolist()), tau_max)
        k, _, n = z.shape
        out = []
        if n > 3 * tau_max + 5:
            flat = z.transpose(1, 0, 2).reshape(lags * k, n)
            c = flat @ flat.T
            np.fill_diagonal(c, 1.0)
            of = {j: _thinned(c, j, k, n, tau_max, pc_alpha, max_conds) for j in range(k)}
            out = [(*key, ids[j], ids[i], t, p) for j in range(k) for i, t, p in _settled(c, j, k, n, of, alpha_level, max_conds)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in LINKS.split(", ")])

    return spread(series, "incident_id").groupBy("incident_id").applyInPandas(run, LINKS)


def lagged_links(metrics: DataFrame, tau_max: int = 3, pc_alpha: float = 0.1, alpha_level: float = 0.01, max_conds: int | None = None, block: int = 16) -> DataFrame:
    """(incident_id, effect, parent, tau, p): time-lagged links by two steps of partial correlation tests.

    Each target's lagged candidates are thinned by growing condition sets of its strongest others, of up
    to all others, or of ``max_conds`` if given; the
    rest are tested given the target's and the candidate's own parents.  Lag 0 is left out.  Correlations are
    summed in blocks of services (``lagged_correlations``, which says what happens to series of different ranges).  An incident of up to
    ``block`` services is one group, and its correlations stay in it.  In a larger one a target is a
    group of its own, with the correlations of the services that correlate with it at all, then with those of its parents and their parents.
    An incident with 3 tau_max + 5 samples or fewer beyond the lags has no link.
    """
    packed = cut(pack(metrics))
    series, many = _shared_range(packed, tau_max), packed.groupBy("incident_id").agg(F.count("*").alias("_k")).where(F.col("_k") > block).select("incident_id")
    if not many.take(1):
        return _links_of_incidents(series, tau_max, pc_alpha, alpha_level, max_conds)
    many = cut(many)
    few = _links_of_incidents(series.join(many, "incident_id", "left_anti"), tau_max, pc_alpha, alpha_level, max_conds)
    return few.unionByName(_links_of_targets(series.join(many, "incident_id", "left_semi"), tau_max, pc_alpha, alpha_level, max_conds, block))


def _links_of_targets(series: DataFrame, tau_max: int, pc_alpha: float, alpha_level: float, max_conds: int | None, block: int) -> DataFrame:
    """The links of incidents of several blocks, a group for each target."""
    lags = 2 * tau_max + 1
    corr = cut(_block_correlations(series, tau_max, block).where(F.col("n") > 3 * tau_max + 5))
    strongest = F.array_max(F.transform(F.slice("r", 2, tau_max), F.abs))
    tied = corr.where(_fisher_z(strongest, F.col("n")) >= _critical(pc_alpha)).select("incident_id", F.col("x").alias("target"), F.col("y").alias("service_id"))
    need = tied.unionByName(tied.select("incident_id", "target", F.col("target").alias("service_id"))).distinct()

    def thin(pdf):
        inc, target, n = pdf["incident_id"].iloc[0], pdf["target"].iloc[0], int(pdf["n"].iloc[0])
        ids, c = _lag_matrix(pdf, lags)
        k = len(ids)
        cand = _thinned(c, ids.index(target), k, n, tau_max, pc_alpha, max_conds)
        return pd.DataFrame([(inc, target, ids[v % k], v // k, pos) for pos, v in enumerate(cand)], columns=["incident_id", "target", "parent", "tau", "pos"])

    parents = cut(spread(_among(need, corr), "incident_id", "target").groupBy("incident_id", "target").applyInPandas(thin, "incident_id string, target int, parent int, tau int, pos int"))
    direct = parents.select("incident_id", "target", F.col("parent").alias("service_id")).distinct()
    own = direct.select("incident_id", "target", F.col("target").alias("service_id")).distinct()
    owners = cut(direct.unionByName(own).distinct())
    of = owners.join(parents.select("incident_id", F.col("target").alias("service_id"), "parent", "tau", "pos"), ["incident_id", "service_id"])
    need = owners.unionByName(of.select("incident_id", "target", F.col("parent").alias("service_id"))).distinct()

    def settle(key, pdf, links):
        n = int(pdf["n"].iloc[0])
        ids, c = _lag_matrix(pdf, lags)
        k = len(ids)
        of = {ids.index(s): (np.searchsorted(ids, g["parent"]) + g["tau"] * k).tolist() for s, g in links.sort_values("pos").groupby("service_id")}
        out = [(key[0], key[1], ids[i], t, p) for i, t, p in _settled(c, ids.index(key[1]), k, n, of, alpha_level, max_conds)]
        return pd.DataFrame(out, columns=["incident_id", "effect", "parent", "tau", "p"])

    keys = ["incident_id", "target"]
    return spread(_among(need, corr), *keys).groupBy(*keys).cogroup(spread(_renewed(of), *keys).groupBy(*keys)).applyInPandas(settle, LINKS)


def partial_correlations(corr: DataFrame, entries: DataFrame, conds: DataFrame) -> DataFrame:
    """|partial correlation| of the entry and each service given its confounders."""
    d = _corr_rows(corr).join(entries.withColumnRenamed("service_id", "entry"), "incident_id").join(conds, "incident_id")

    def run(it):
        for pdf in it:
            out = []
            for r in pdf.itertuples(index=False):
                ids, m = _square(r.c)
                at = {s: k for k, s in enumerate(ids)}
                ok = r.entry in at and r.service_id in at
                out.append((r.incident_id, r.service_id, abs(partial_corr(m, at[r.entry], at[r.service_id], [at[s] for s in r.cond if s in at])) if ok else None))
            yield pd.DataFrame(out, columns=["incident_id", "service_id", "corr"])

    return d.mapInPandas(run, "incident_id string, service_id int, corr double")
