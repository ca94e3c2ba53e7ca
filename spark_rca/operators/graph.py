"""Graph building, paths, walks and rankings; edges are (incident_id, src, dst, weight)."""

from __future__ import annotations

import heapq
import math
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spark_rca.functions.scalars import path_mean
from spark_rca.operators.blocks import spread
from spark_rca.operators.lineage import cut
from spark_rca.operators.relate import add_backward_edges, path_node_counts, second_order_states, top_paths
from spark_rca.operators.windows import adaptive_threshold, normalize


def transition_graph(strength: DataFrame, ratio: float) -> DataFrame:
    """Thresholded edge strengths, normalised by column."""
    return normalize(adaptive_threshold(strength, ratio), "dst")


def _walk_paths(edges: DataFrame, starts: DataFrame, end_col: str, next_col: str, max_len: int | None, cap: int | None) -> tuple[DataFrame, DataFrame]:
    """Simple paths level by level: (all partial paths, the steps they take); without ``max_len`` until none grows."""
    edges, starts = cut(edges), cut(starts)
    step = edges.where("weight > 0").select("incident_id", F.col(end_col).alias("_at"), F.col(next_col).alias("_to"), F.col("weight").alias("_w"))
    front = starts.select("incident_id", F.col("service_id").alias("entry"), F.array("service_id").alias("path"), F.array().cast("array<double>").alias("edge_probs"))
    levels = [front]
    while max_len is None or len(levels) < max_len:
        wide = levels[-1].withColumn("_at", F.element_at("path", -1)).join(step, ["incident_id", "_at"]).where(~F.array_contains("path", F.col("_to")))
        nxt = wide.select("incident_id", "entry", F.concat("path", F.array("_to")).alias("path"), F.concat("edge_probs", F.array("_w")).alias("edge_probs"))
        if cap is not None:
            rank = F.row_number().over(Window.partitionBy("incident_id").orderBy("path"))
            nxt = nxt.withColumn("_r", rank).where(F.col("_r") <= cap).drop("_r")
        levels.append(cut(nxt))
        if not levels[-1].take(1):
            break
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out, step


def backtrace_paths(edges: DataFrame, entries: DataFrame, max_len: int, reach_end: bool = True, cap: int | None = None) -> DataFrame:
    """Simple paths from the entry over predecessors with weight over 0.

    A path is emitted at a node without predecessors or at the maximum length; one that can only
    repeat a node is dropped, unless ``reach_end`` is false.  With ``cap``, at most so many paths per incident and
    level go on, in the order of their nodes; ``best_paths`` finds the most probable ones without listing all.
    """
    every, step = _walk_paths(edges, entries, "dst", "src", max_len, cap)
    ends = every.withColumn("_at", F.element_at("path", -1))
    has = step.select("incident_id", "_at").distinct().withColumn("_more", F.lit(True))
    ends = ends.join(has, ["incident_id", "_at"], "left")
    done = F.col("_more").isNull() | (F.size("path") == max_len)
    if not reach_end:
        stuck = every.withColumn("_at", F.element_at("path", -1)).join(step, ["incident_id", "_at"]).groupBy("incident_id", "path").agg(F.bool_or(F.array_contains("path", F.col("_to"))).alias("_rep"))
        ends = ends.join(stuck, ["incident_id", "path"], "left")
        done = done | F.coalesce("_rep", F.lit(False))
    return ends.where(done).select("incident_id", "entry", "path", "edge_probs")


def _search(edges: dict[int, list[tuple[int, float]]], entries: list[int], max_len: int, k: int, mean: str, reach_end: bool) -> list[tuple[int, list[int], list[float]]]:
    """The k most probable paths of one graph, and all that tie with the last of them, by best-first search.

    A partial path stands at the best mean that any end of it could have: with as many of the graph's best edge as fit, or with
    one or none, for a mean moves towards that edge.  Partial paths that cannot reach the k-th best whole one any more go.
    """
    slack = 1 + 1e-9
    term = {"arithmetic": lambda w: w, "geometric": math.log, "harmonic": lambda w: 1 / w}[mean]
    counts = [w for near in edges.values() for _, w in near if mean == "arithmetic" or w != 1]
    best = max(counts, default=None)

    def value(total: float, n: int) -> float:
        if n == 0:
            return 0.0 if mean == "arithmetic" else -1.0  # the mean is NULL, the last in order
        return total / n if mean == "arithmetic" else math.exp(total / n) if mean == "geometric" else n / total

    def bound(total: float, n: int, left: int) -> float:
        if best is None:
            return value(total, n)
        return max([value(total, n)] + [value(total + r * term(best), n + r) for r in (1, left)])

    heap, whole, order = [], [], count()
    least = -math.inf

    def push(entry, path, probs, total, n):
        nonlocal least
        near = edges.get(path[-1], ())
        done = not near or len(path) == max_len or (not reach_end and any(x in path for x, _ in near))
        if done:
            v = value(total, n)
            whole.append((v, entry, path, probs))
            heapq.heappush(top, v)
            if len(top) > k:
                heapq.heappop(top)
            if len(top) == k:
                least = top[0]
        if near and len(path) < max_len:
            b = bound(total, n, max_len - len(path))
            if b * slack >= least:
                heapq.heappush(heap, (-b, -len(path), next(order), entry, path, probs, total, n))

    top: list[float] = []
    for e in sorted(entries):
        push(e, [e], [], 0.0, 0)
    while heap:
        b, _, _, entry, path, probs, total, n = heapq.heappop(heap)
        if -b * slack < least:
            break
        for x, w in edges[path[-1]]:
            if x not in path:
                one = mean != "arithmetic" and w == 1
                push(entry, [*path, x], [*probs, w], total if one else total + term(w), n if one else n + 1)
    return [(entry, path, probs) for v, entry, path, probs in whole if v * slack >= least or v >= least]


def best_paths(edges: DataFrame, entries: DataFrame, max_len: int, k: int, mean: str = "harmonic", least: float = 0.0, reach_end: bool = True) -> DataFrame:
    """(incident_id, entry, path, edge_probs, prob, pos, capped): what ``top_paths`` takes of all of ``backtrace_paths``, without listing these.

    The search is exact, so ``capped`` is false.  An incident is a task's group: its edges, and the partial paths that may still win.
    """

    def run(key, edge, entry):
        graph: dict[int, list[tuple[int, float]]] = {}
        for s, d, w in zip(edge["src"].tolist(), edge["dst"].tolist(), edge["weight"].tolist(), strict=True):
            if w > 0:
                graph.setdefault(d, []).append((s, w))
        found = _search(graph, entry["service_id"].tolist(), max_len, k, mean, reach_end)
        return pd.DataFrame([(key[0], *x) for x in found], columns=["incident_id", "entry", "path", "edge_probs"])

    own = entries.select(F.col("incident_id").alias("incident_id"), F.col("service_id").alias("service_id"))
    found = spread(edges, "incident_id").groupBy("incident_id").cogroup(spread(own, "incident_id").groupBy("incident_id")).applyInPandas(run, "incident_id string, entry int, path array<int>, edge_probs array<double>")
    return top_paths(score_paths(found, mean), k, least).withColumn("capped", F.lit(False))


def score_paths(paths: DataFrame, method: str = "harmonic") -> DataFrame:
    return paths.withColumn("prob", path_mean(F.col("edge_probs"), method))


def ranknode(paths: DataFrame, corr: DataFrame, topk: int, num_sel: int, least: float = 0.0) -> DataFrame:
    """Share of a node among the ends of the best paths, plus its |correlation| with the entry."""
    counts = path_node_counts(top_paths(paths, topk, least), num_sel)
    d = counts.join(corr, ["incident_id", "service_id"], "left")
    return d.select("incident_id", "service_id", (F.col("cnt") / float(num_sel * topk) + F.coalesce("corr", F.lit(0.0))).alias("score"))


def monitor_rank_transition(edges: DataFrame, corr: DataFrame, entries: DataFrame, rho: float) -> DataFrame:
    """Forward edges weigh |S_j|, missing reverse edges rho * |S_i|, self the excess over the row's best; rows sum to 1."""
    s = corr.select("incident_id", F.col("service_id").alias("dst"), F.col("corr").alias("_s"))
    fwd = edges.select("incident_id", "src", "dst").join(s, ["incident_id", "dst"]).select("incident_id", "src", "dst", F.abs("_s").alias("weight"))
    own = corr.select("incident_id", F.col("service_id").alias("src"), F.col("corr").alias("_o"))
    both = add_backward_edges(fwd)
    marked = both.join(fwd.select("incident_id", "src", "dst", F.lit(True).alias("_f")), ["incident_id", "src", "dst"], "left").join(s, ["incident_id", "dst"])
    both = marked.select("incident_id", "src", "dst", F.when(F.col("_f"), F.abs("_s")).otherwise(rho * F.abs("_s")).alias("weight"))
    best = both.groupBy("incident_id", "src").agg(F.max("weight").alias("_m"))
    selves = own.join(best, ["incident_id", "src"], "left").join(entries.select("incident_id", F.col("service_id").alias("src"), F.lit(True).alias("_e")), ["incident_id", "src"], "left")
    selves = selves.where("_e IS NULL").select("incident_id", "src", F.col("src").alias("dst"), F.greatest(F.lit(0.0), F.col("_o") - F.coalesce("_m", F.lit(0.0))).alias("weight"))
    return normalize(both.unionByName(selves.where("weight > 0")), "src")


def cloud_ranger_transition(edges: DataFrame, corr: DataFrame, beta: float, rho: float) -> DataFrame:
    """(incident_id, prev, cur, next, prob): second-order transitions over edges, their reverses and self steps.

    Forward: (1 - beta) P[prev, cur] + beta P[cur, next], normalised; reverse edges of ``cur`` weigh
    rho ((1 - beta) P[prev, cur] + beta P[next, cur]), normalised among themselves; the self step is
    the excess of the node's correlation over the others'.  All of (prev, cur) then sum to 1.
    """
    s = corr.select("incident_id", F.col("service_id").alias("dst"), F.abs("corr").alias("_s"))
    p = normalize(edges.select("incident_id", "src", "dst").join(s, ["incident_id", "dst"]).select("incident_id", "src", "dst", F.col("_s").alias("weight")), "src")
    st = Window.partitionBy("incident_id", "prev", "cur")
    fwd = second_order_states(p).select("incident_id", "prev", "cur", "next", ((1 - beta) * F.col("w1") + beta * F.col("w2")).alias("prob"))
    inn = p.select("incident_id", F.col("dst").alias("cur"), F.col("src").alias("next"), F.col("weight").alias("w2"))
    bwd = p.select("incident_id", F.col("src").alias("prev"), F.col("dst").alias("cur"), F.col("weight").alias("w1")).join(inn, ["incident_id", "cur"])
    bwd = bwd.join(fwd.select("incident_id", "prev", "cur", "next"), ["incident_id", "prev", "cur", "next"], "left_anti")
    bwd = bwd.select("incident_id", "prev", "cur", "next", (rho * ((1 - beta) * F.col("w1") + beta * F.col("w2"))).alias("prob"))
    share = lambda d: d.withColumn("prob", F.col("prob") / F.when(F.sum("prob").over(st) > 0, F.sum("prob").over(st)))
    both = share(fwd).unionByName(share(bwd))
    sig = corr.select("incident_id", F.col("service_id").alias("cur"), F.col("corr").alias("_c"))
    nxt = corr.select("incident_id", F.col("service_id").alias("next"), F.col("corr").alias("_n"))
    top = both.join(nxt, ["incident_id", "next"]).where("next <> cur").groupBy("incident_id", "prev", "cur").agg(F.max("_n").alias("_m"))
    selves = top.join(sig, ["incident_id", "cur"]).select("incident_id", "prev", "cur", F.col("cur").alias("next"), F.greatest(F.lit(0.0), F.col("_c") - F.col("_m")).alias("prob"))
    selves = selves.join(both.select("incident_id", "prev", "cur", "next"), ["incident_id", "prev", "cur", "next"], "left_anti")
    return share(both.unionByName(selves.where("prob > 0")).where("prob > 0"))


#: Steps (edges or second-order transitions) of an incident up to which a walk over it is one group's work; beyond, each step is a join.
WALK_EDGES = 1_000_000


def _walked(steps: DataFrame, start: DataFrame, jump: DataFrame | None, n: int, nodes: list[str], limit: int) -> DataFrame:
    """(incident_id, *nodes, visits): visits of the states ``nodes`` in n steps from ``start`` (incident_id, *nodes, m), summed over the steps.

    ``steps`` are (incident_id, *nodes, the same with _ in front, w).  ``jump`` (incident_id, *nodes, w), w summing to 1, is
    where mass at a state without steps goes.  Incidents of up to ``limit`` steps are groups, sparse in memory.  For larger ones each
    step is a join on the state and a sum with partial sums before the shuffle, so that hubs are no hot keys; what is kept between two steps is
    one row per state in the shared folder.
    """
    names = [f"_{c}" for c in nodes]
    steps = cut(steps)
    many = steps.groupBy("incident_id").agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select("incident_id")
    some = bool(many.take(1))
    if some:
        many, start = cut(many), cut(start)
    part = lambda d, how: d.join(many, "incident_id", how)
    struct = lambda *c: F.collect_list(F.struct(*c))
    d = (part(steps, "left_anti") if some else steps).groupBy("incident_id").agg(struct(*nodes, *names, "w").alias("e")).join(start.groupBy("incident_id").agg(struct(*nodes, "m").alias("s")), "incident_id")
    if jump is not None:
        d = d.join(jump.groupBy("incident_id").agg(struct(*nodes, "w").alias("j")), "incident_id", "left")

    def run(it):
        for pdf in it:
            out = []
            for r in pdf.itertuples(index=False):
                jumps = getattr(r, "j", None)
                edge, first = pd.DataFrame.from_records(list(r.e)), pd.DataFrame.from_records(list(r.s))
                leap = pd.DataFrame.from_records(list(jumps)) if jumps is not None else None
                keys = [edge[nodes].to_numpy(), edge[names].to_numpy(), first[nodes].to_numpy(), *([] if leap is None else [leap[nodes].to_numpy()])]
                states, at = np.unique(np.concatenate(keys), axis=0, return_inverse=True)
                cuts = np.cumsum([len(k) for k in keys])[:-1]
                a, b, s, *j = np.split(at.ravel(), cuts)
                k, w = len(states), edge["w"].to_numpy()
                v, total = np.bincount(s, first["m"], k), np.zeros(k)
                dead = np.bincount(a, minlength=k) == 0
                leaps = np.bincount(j[0], leap["w"], k) if j else None
                for _ in range(n):
                    lost = v[dead].sum()
                    v = np.bincount(b, v[a] * w, k)
                    if leaps is not None:
                        v = v + lost * leaps
                    total += v
                out += [(r.incident_id, *map(int, x), float(t)) for x, t in zip(states, total, strict=True)]
            yield pd.DataFrame(out, columns=["incident_id", *nodes, "visits"])

    done = d.mapInPandas(run, f"incident_id string, {', '.join(f'{c} int' for c in nodes)}, visits double")
    if not some:
        return done
    key = ["incident_id", *nodes]
    big = cut(part(steps, "left_semi"))
    v = cut(part(start, "left_semi").select(*key, "m"))
    ends = big.select("incident_id", *[F.col(x).alias(c) for x, c in zip(names, nodes, strict=True)])
    leaps = cut(part(jump, "left_semi")) if jump is not None else None
    every = big.select(*key).unionByName(ends).unionByName(v.select(*key))
    total = cut((every if leaps is None else every.unionByName(leaps.select(*key))).distinct().withColumn("visits", F.lit(0.0)))
    for _ in range(n):
        moved = v.join(big, key).select("incident_id", *[F.col(x).alias(c) for x, c in zip(names, nodes, strict=True)], (F.col("m") * F.col("w")).alias("m"))
        if leaps is not None:
            lost = v.join(big.select(*key).distinct(), key, "left_anti").groupBy("incident_id").agg(F.sum("m").alias("_m"))
            moved = moved.unionByName(leaps.join(lost, "incident_id").select(*key, (F.col("_m") * F.col("w")).alias("m")))
        v = cut(moved.groupBy(*key).agg(F.sum("m").alias("m")))
        total = cut(total.join(v, key, "left").select(*key, (F.col("visits") + F.coalesce("m", F.lit(0.0))).alias("visits")))
    return done.unionByName(total)


def expected_visits(transitions: DataFrame, entries: DataFrame, steps: int, teleport: DataFrame | None = None, restart: bool = True, limit: int = WALK_EDGES) -> DataFrame:
    """Expected visits of a walk of ``steps`` steps from the entry: v <- vP, summed.

    Without ``restart``, mass that reaches a dead end jumps by the ``teleport`` weights (service_id,
    weight); with it, the walk stops there.  Expected values replace seeded walks, so results don't
    depend on partitioning.  Incidents of more than ``limit`` edges are walked by joins, see ``_walked``.
    """
    edges = transitions.groupBy("incident_id", F.col("src").alias("s"), F.col("dst").alias("_s")).agg(F.sum("weight").alias("w"))
    start = entries.join(transitions.select("incident_id").distinct(), "incident_id").select("incident_id", F.col("service_id").alias("s"), F.lit(1.0).alias("m"))
    jump = None
    if teleport is not None:
        all_ = F.sum("weight").over(Window.partitionBy("incident_id"))
        share = F.when(all_ > 0, F.col("weight") / F.when(all_ > 0, all_)).otherwise(0.0) if not restart else F.lit(0.0)
        jump = teleport.withColumn("weight", F.coalesce("weight", F.lit(0.0))).select("incident_id", F.col("service_id").alias("s"), share.alias("w"))
    # A state whose steps weigh nothing is a dead end, but a state.
    live = edges.where("w > 0")
    still = edges.select("incident_id", F.explode(F.array("s", "_s")).alias("s")).distinct().withColumn("m", F.lit(0.0))
    start = start.unionByName(still).groupBy("incident_id", "s").agg(F.sum("m").alias("m"))
    out = _walked(live, start, jump, steps, ["s"], limit)
    return out.select("incident_id", F.col("s").alias("service_id"), "visits")


def second_order_visits(states: DataFrame, entries: DataFrame, steps: int, limit: int = WALK_EDGES) -> DataFrame:
    """Expected visits over (prev, cur) states from (entry, entry); a state without steps ends the walk.

    Where nothing leaves (entry, entry), the first step is of first order: to each service that follows the entry, alike.
    """
    states = cut(states)
    e = entries.select("incident_id", F.col("service_id").alias("p"))
    edges = states.select("incident_id", F.col("prev").alias("p"), F.col("cur").alias("c"), F.col("cur").alias("_p"), F.col("next").alias("_c"), F.col("prob").alias("w"))
    from_entry = edges.join(e, ["incident_id", "p"]).select("incident_id", "p", "c").distinct()
    own = F.max(F.col("p") == F.col("c")).over(Window.partitionBy("incident_id"))
    n = F.count("*").over(Window.partitionBy("incident_id"))
    first = from_entry.withColumn("_own", own).withColumn("_n", n)
    first = first.select("incident_id", "p", "c", F.when(F.col("_own"), (F.col("p") == F.col("c")).cast("double")).otherwise(1 / F.col("_n")).alias("m"))
    still = edges.select("incident_id").distinct().join(e, "incident_id").select("incident_id", "p", F.col("p").alias("c"), F.lit(0.0).alias("m"))
    start = first.unionByName(still).groupBy("incident_id", "p", "c").agg(F.sum("m").alias("m"))
    out = _walked(edges, start, None, steps, ["p", "c"], limit)
    return out.groupBy("incident_id", F.col("c").alias("service_id")).agg(F.sum("visits").alias("visits"))


def resample_graph_by_walk(edges: DataFrame, entries: DataFrame, steps: int, back: float = 0.8, ahead: float = 0.1, stay: float = 0.1) -> DataFrame:
    """Edges reweighted by how often a walk from the entry is expected to use them, normalised by column.

    A step goes to a predecessor with chance 0.8, to a successor with 0.1, or stays, by edge weight.
    """
    pre = normalize(edges, "dst").select("incident_id", F.col("dst").alias("src"), F.col("src").alias("dst"), (back * F.col("weight")).alias("weight"))
    suc = normalize(edges, "src").select("incident_id", "src", "dst", (ahead * F.col("weight")).alias("weight"))
    nodes = edges.select("incident_id", F.explode(F.array("src", "dst")).alias("src")).distinct()
    step = pre.unionByName(suc).unionByName(nodes.select("incident_id", "src", F.col("src").alias("dst"), F.lit(stay).alias("weight")))
    v = expected_visits(step, entries, steps).unionByName(entries.select("incident_id", "service_id", F.lit(1.0).alias("visits"))).groupBy("incident_id", "service_id").agg(F.sum("visits").alias("visits"))
    used = pre.join(v.withColumnRenamed("service_id", "src"), ["incident_id", "src"]).select("incident_id", F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") * F.col("visits")).alias("weight"))
    return normalize(used.where("weight > 0"), "dst")


def netmedic_edge_weight(edges: DataFrame, stats: DataFrame, chunks: DataFrame, samples: DataFrame | None, k: int | None = None, delta: float = 1 / 3) -> DataFrame:
    """How well the source's past resemblance to now goes with the destination's.

    ``stats`` has cur, lo and hi; ``chunks`` has chunk means of the history.  Weight w_k of a chunk is
    1 - |source - now| / range if that difference is at most ``delta``, else 0; the edge is the
    weighted mean of the destination's likeness, 0.8 if all weights are 0.  ``samples`` (service_id,
    chunk, mean) replaces the source's chunks by its k-th raw samples, a kept quirk.
    """
    def likeness(d, name, source):
        s = stats.select("incident_id", "service_id", "cur", "lo", "hi")
        x = source.join(s, ["incident_id", "service_id"])
        diff = F.coalesce(F.abs(F.col("mean") - F.col("cur")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
        return d.join(x.select("incident_id", F.col("service_id").alias(name), "chunk", diff.alias(f"d_{name}")), ["incident_id", name] + (["chunk"] if "chunk" in d.columns else []))

    d = likeness(edges.select("incident_id", "src", "dst"), "src", samples if samples is not None else chunks)
    d = likeness(d if k is None else d.where(F.col("chunk") < k), "dst", chunks)
    w = F.when(F.col("d_src") <= delta, 1 - F.col("d_src")).otherwise(0.0)
    g = d.groupBy("incident_id", "src", "dst").agg(F.sum(w).alias("_w"), F.sum(w * (1 - F.col("d_dst"))).alias("_s"))
    return g.select("incident_id", "src", "dst", F.when(F.col("_w") > 0, F.col("_s") / F.when(F.col("_w") > 0, F.col("_w"))).otherwise(0.8).alias("weight"))


def netmedic_paths(edges: DataFrame, max_len: int | None = None) -> DataFrame:
    """(incident_id, c, e, edge_probs): simple forward paths from every node to a node that is a sink or has an edge back into the path.

    All of them, of up to ``max_len`` nodes if given; their number can grow exponentially with the nodes of a dense graph.
    """
    nodes = edges.select("incident_id", F.explode(F.array("src", "dst")).alias("service_id")).distinct()
    every, step = _walk_paths(edges, nodes, "src", "dst", max_len, None)
    d = every.withColumn("_at", F.element_at("path", -1)).where(F.size("path") > 1)
    out = d.join(step.select("incident_id", "_at", "_to"), ["incident_id", "_at"], "left")
    ends = out.groupBy("incident_id", "entry", "path", "edge_probs").agg(F.bool_or(F.col("_to").isNull() | F.array_contains("path", F.col("_to"))).alias("_ok"))
    return ends.where("_ok").select("incident_id", F.col("entry").alias("c"), F.element_at("path", -1).alias("e"), "path", "edge_probs")


def impact_matrix(paths: DataFrame, services: DataFrame) -> DataFrame:
    """(incident_id, c, e, impact): best geometric mean over paths; 1 for c = e, 0.01 without a path."""
    prod = F.aggregate("edge_probs", F.lit(0.0), lambda s, x: s + F.ln(x))
    best = paths.groupBy("incident_id", "c", "e").agg(F.max(F.exp(prod / F.size("edge_probs"))).alias("_i"))
    a = services.select("incident_id", F.col("service_id").alias("c"))
    b = services.select("incident_id", F.col("service_id").alias("e"))
    d = a.join(b, "incident_id").join(best, ["incident_id", "c", "e"], "left")
    return d.select("incident_id", "c", "e", F.when(F.col("c") == F.col("e"), 1.0).otherwise(F.coalesce("_i", F.lit(0.01))).alias("impact"))


def netmedic_rank(impact: DataFrame, total: DataFrame, entries: DataFrame) -> DataFrame:
    """score = 1 / (impact on the entry * global impact); the smallest is the likeliest cause."""
    e = impact.join(entries.withColumnRenamed("service_id", "e"), ["incident_id", "e"]).select("incident_id", F.col("c").alias("service_id"), F.col("impact").alias("_i"))
    d = e.join(total, ["incident_id", "service_id"])
    v = F.col("_i") * F.col("impact")
    return d.select("incident_id", "service_id", (1 / F.when(v > 0, v)).alias("score"))


def _reach(edges: DataFrame, ways: dict[str, tuple[str, str]], max_depth: int) -> DataFrame:
    """(incident_id, way, service_id, other, depth), breadth first in all ways at once; a way is the columns that its steps go from and to."""
    edges = cut(edges)
    key = ["incident_id", "way", "service_id", "other"]
    steps = F.explode(F.array(*[F.struct(F.lit(w).alias("way"), F.col(a).alias("_at"), F.col(b).alias("_to")) for w, (a, b) in ways.items()]))
    step = edges.where("weight > 0").select("incident_id", steps.alias("_s")).select("incident_id", "_s.*").distinct()
    nodes = edges.select("incident_id", F.explode(F.array("src", "dst")).alias("service_id")).distinct()
    seen = nodes.select("incident_id", F.explode(F.array(*[F.lit(w) for w in ways])).alias("way"), "service_id", F.col("service_id").alias("other"), F.lit(0).alias("depth"))
    seen = front = cut(seen)
    for depth in range(1, max_depth + 1):
        nxt = front.withColumnRenamed("other", "_at").join(step, ["incident_id", "way", "_at"]).select("incident_id", "way", "service_id", F.col("_to").alias("other")).distinct()
        front = cut(nxt.join(seen, key, "left_anti").withColumn("depth", F.lit(depth)))
        if not front.take(1):
            break
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


WAYS = {"callers": ("src", "dst"), "callees": ("dst", "src")}


def reach(edges: DataFrame, direction: str, max_depth: int = 20) -> DataFrame:
    """(incident_id, service_id, other, depth): nodes reachable by out-edges (callers) or in-edges (callees), breadth first, in up to ``max_depth`` steps."""
    return _reach(edges, {direction: WAYS[direction]}, max_depth).drop("way")


def reach_both(edges: DataFrame, max_depth: int = 20) -> tuple[DataFrame, DataFrame]:
    """``reach`` of callers and of callees, found level by level together."""
    d = _reach(edges, WAYS, max_depth)
    return d.where("way = 'callers'").drop("way"), d.where("way = 'callees'").drop("way")


def tbac_rating(corr: DataFrame, callers: DataFrame, callees: DataFrame) -> DataFrame:
    """score = 2 corr - 1, moved up if the callers' weighted mean is over it and no callee is, down in the reverse case.

    Without callers or callees their condition counts as satisfied; the second rule wins.
    """
    s = corr.select("incident_id", "service_id", (2 * F.col("corr") - 1).alias("s"))
    o = s.select("incident_id", F.col("service_id").alias("other"), F.col("s").alias("_o"))
    s_in = callers.join(o, ["incident_id", "other"]).groupBy("incident_id", "service_id").agg((F.sum(F.col("_o") / F.col("depth")) / F.sum(1 / F.col("depth"))).alias("s_in"))
    s_out = callees.join(o, ["incident_id", "other"]).groupBy("incident_id", "service_id").agg(F.max("_o").alias("s_out"))
    d = s.join(s_in, ["incident_id", "service_id"], "left").join(s_out, ["incident_id", "service_id"], "left")
    c = F.col
    up = F.coalesce(c("s_in") > c("s"), F.lit(True)) & F.coalesce(c("s_out") <= c("s"), F.lit(True))
    down = F.coalesce(c("s_in") <= c("s"), F.lit(True)) & F.coalesce(c("s_out") > c("s"), F.lit(True))
    return d.select("incident_id", "service_id", F.when(down, (c("s") - 1) / 2).when(up, (c("s") + 1) / 2).otherwise(c("s")).alias("score"))


def microcause_q(edges: DataFrame, corr: DataFrame, entries: DataFrame, rho: float, selves: bool = True, flip: bool = False) -> DataFrame:
    """Transition weights for the root-cause walk; edges point from effect to parent.

    An edge weighs |corr(entry, dst)|, a missing reverse rho * |corr(entry, src)|, self the excess of a
    node over its neighbours' best; the entry's own correlation is 0.  Rows sum to 1.  ``flip`` takes
    the edges in the other direction (the form for partial correlations, without self steps).
    """
    if flip:
        edges = edges.select("incident_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    zero = corr.join(entries.withColumn("_e", F.lit(True)), ["incident_id", "service_id"], "left").select("incident_id", "service_id", F.when(F.col("_e"), 0.0).otherwise(F.abs(F.coalesce("corr", F.lit(0.0)))).alias("c"))
    d = zero.select("incident_id", F.col("service_id").alias("dst"), "c")
    fwd = edges.select("incident_id", "src", "dst").distinct()
    back = fwd.select("incident_id", F.col("dst").alias("src"), F.col("src").alias("dst")).join(fwd, ["incident_id", "src", "dst"], "left_anti")
    both = fwd.withColumn("_k", F.lit(1.0)).unionByName(back.withColumn("_k", rho * F.lit(1.0))).join(d, ["incident_id", "dst"]).select("incident_id", "src", "dst", (F.col("_k") * F.col("c")).alias("weight"))
    if selves:
        best = both.groupBy("incident_id", "src").agg(F.max("weight").alias("_m"))
        own = zero.select("incident_id", F.col("service_id").alias("src"), "c").join(best, ["incident_id", "src"])
        both = both.unionByName(own.select("incident_id", "src", F.col("src").alias("dst"), F.greatest(F.lit(0.0), F.col("c") - F.col("_m")).alias("weight")))
    return normalize(both.where("weight > 0"), "src")


def gamma_scores(visits: DataFrame, eta: DataFrame, lam: float) -> DataFrame:
    """lam * visits / max + (1 - lam) * eta / max; a maximum of 0 gives 0."""
    d = visits.join(eta, ["incident_id", "service_id"])
    w = Window.partitionBy("incident_id")

    def share(c: str) -> Column:
        m = F.max(c).over(w)
        return F.when(m > 0, F.col(c) / F.when(m > 0, m)).otherwise(0.0)

    return d.select("incident_id", "service_id", (lam * share("visits") + (1 - lam) * share("eta")).alias("score"))


def graph_at(curves: DataFrame, used: DataFrame, t: int, least: float) -> DataFrame:
    """Edges on paths with their curve's share of its maximum at one t, where over ``least``."""
    m = F.max("cnt").over(Window.partitionBy("incident_id", "x", "y"))
    at = curves.withColumn("weight", F.when(m > 0, F.col("cnt") / F.when(m > 0, m)).otherwise(0.0)).where(F.col("t") == t)
    edges = at.select("incident_id", F.col("x").alias("src"), F.col("y").alias("dst"), "weight")
    return edges.where(F.col("weight") > least).join(used, ["incident_id", "src", "dst"], "left_semi")
