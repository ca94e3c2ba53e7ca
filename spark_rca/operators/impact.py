"""Impact of one service on another: the best mean over simple paths, found without listing the paths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_rca.operators.blocks import spread

#: Starts that share one copy of their incident's edges.
STARTS = 8
IMPACTS = "incident_id string, c int, e int, impact double, path array<int>"


def _bounds(logs: np.ndarray, free: np.ndarray, end: int, back: np.ndarray, left: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, met, open): log-products of the best walks of 0 to ``left`` edges from each free node to ``end`` inside the free nodes.

    ``met`` is for paths that hold a node of ``back`` already, ``open`` for walks that still have to meet one.
    """
    nodes = np.flatnonzero(free)
    step = logs[np.ix_(nodes, nodes)]
    at, hit = int(np.searchsorted(nodes, end)), back[nodes]
    step[at] = -np.inf
    rows = min(left, len(nodes) - 1) + 1
    met = np.full((rows, len(nodes)), -np.inf)
    met[0, at] = 0.0
    for r in range(1, rows):
        met[r] = (step + met[r - 1]).max(axis=1)
    wait = np.where(hit, met, -np.inf)
    for r in range(1, rows):
        wait[r] = np.where(hit, met[r], (step + wait[r - 1]).max(axis=1))
    return nodes, met, wait


def best_mean_path(logs: np.ndarray, start: int, end: int, max_len: int) -> tuple[float, list[int]] | None:
    """The simple path from ``start`` to ``end`` of the best mean log weight, among those whose end is a sink or has an edge back into the path.

    Depth first, best bound first.  No path over the nodes that are left has a better mean than the best walk over them of the same number
    of edges, so a branch whose walks can't beat the best path so far is left out.  Exact; memory is one order of nodes for each node of the path.
    """
    n = len(logs)
    out = logs[end] > -np.inf
    back = out if out.any() else np.ones(n, bool)
    best, found = -np.inf, None

    def children(path, free, total, met):
        nodes, closed, wait = _bounds(logs, free, end, back, max_len - len(path) - 1)
        left = np.arange(len(closed))[:, None]
        top = ((total + logs[path[-1], nodes] + (closed if met else wait)) / (len(path) + left)).max(axis=0)
        order = np.argsort(-top, kind="stable")
        return iter(zip(top[order].tolist(), nodes[order].tolist(), strict=True))

    free = np.ones(n, bool)
    free[start] = False
    if max_len < 2 or start == end:
        return None
    stack = [([start], free, 0.0, bool(back[start]), children([start], free, 0.0, bool(back[start])))]
    while stack:
        path, free, total, met, near = stack[-1]
        top, x = next(near, (-np.inf, -1))
        if top <= best:
            stack.pop()
            continue
        longer, s, m = [*path, x], total + logs[path[-1], x], met or bool(back[x])
        if x == end:
            if m and s / len(path) > best:
                best, found = s / len(path), longer
            continue
        rest = free.copy()
        rest[x] = False
        stack.append((longer, rest, s, m, children(longer, rest, s, m)))
    return None if found is None else (float(best), found)


def best_impacts(edges: DataFrame, max_len: int | None = None) -> DataFrame:
    """(incident_id, c, e, impact, path): the best geometric mean of edge weights over the paths that ``netmedic_paths`` lists, c other than e.

    ``max_len`` bounds the nodes of a path.  Nothing is listed or capped: each pair is searched by branch and bound.  Starts are dealt in
    small blocks, each with the edges of its incident, so one incident fills many tasks.  Of repeated edges the heaviest counts; edges of weight 0
    or null are none.  The search can take exponential time where many paths nearly tie, but not exponential memory.
    """
    kept = edges.where("weight > 0").groupBy("incident_id", "src", "dst").agg(F.max("weight").alias("weight"))
    graph = kept.groupBy("incident_id").agg(F.collect_list(F.struct("src", "dst", "weight")).alias("edges"))
    starts = kept.groupBy("incident_id").agg(F.array_sort(F.collect_set("src")).alias("s"))
    blocks = starts.select("incident_id", F.explode(F.sequence(F.lit(0), F.floor((F.size("s") - 1) / STARTS).cast("int"))).alias("block"), "s")
    blocks = blocks.select("incident_id", "block", F.slice("s", F.col("block") * STARTS + 1, STARTS).alias("starts"))

    def run(it):
        for pdf in it:
            out = []
            for r in pdf.itertuples(index=False):
                src, dst, w = (np.array([x[k] for x in r.edges]) for k in ("src", "dst", "weight"))
                ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
                logs = np.full((len(ids), len(ids)), -np.inf)
                logs[at[: len(src)], at[len(src) :]] = np.log(w)
                for c in np.searchsorted(ids, np.asarray(r.starts)).tolist():
                    for e in range(len(ids)):
                        got = best_mean_path(logs, c, e, max_len or len(ids))
                        if got is not None:
                            out.append((r.incident_id, int(ids[c]), int(ids[e]), float(np.exp(got[0])), ids[got[1]].tolist()))
            yield pd.DataFrame(out, columns=["incident_id", "c", "e", "impact", "path"])

    dealt = spread(graph.join(blocks, "incident_id"), "incident_id", "block")
    return dealt.mapInPandas(run, IMPACTS)


def full_impact(best: DataFrame, services: DataFrame) -> DataFrame:
    """(incident_id, c, e, impact) of all pairs of services: 1 for c = e, 0.01 without a path."""
    a = services.select("incident_id", F.col("service_id").alias("c"))
    b = services.select("incident_id", F.col("service_id").alias("e"))
    d = a.join(b, "incident_id").join(best.select("incident_id", "c", "e", F.col("impact").alias("_i")), ["incident_id", "c", "e"], "left")
    return d.select("incident_id", "c", "e", F.when(F.col("c") == F.col("e"), 1.0).otherwise(F.coalesce("_i", F.lit(0.01))).alias("impact"))
