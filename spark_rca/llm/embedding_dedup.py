"""Embedding near-duplicates by NN-descent.

Equal vectors collapse first.  Seed lists come from cross-polytope tables: vectors that share the
signed largest coordinates of random rotations meet in bounded blocks.  NN-descent then joins
neighbours of neighbours and keeps each vector's best ``k`` until no list changes.  Lists that are full
of links are saturated: links inside a connected group are counted in blocks of vectors, and links
between the saturated vectors of different groups are looked for in all pairs of their blocks that can
hold one by the triangle inequality of angles.  Recall is audited per vector, small and large groups
apart, and rounds with new tables follow until it suffices; if it never does, all vectors are compared
in blocks.  Only pairs whose double-precision cosine reaches the threshold are links.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spark_rca.llm.common import connected_components, materialize

#: Neighbours in a list, members of a seed block, audited vectors of each kind, recall that ends the search.
LIST, BLOCK, AUDIT, ENOUGH = 16, 64, 200, 0.98
#: Vectors in a block of the fallback, centres in a block of the ball test.
WIDE = 2048


def usable(vec_id: str, embedding: str) -> Column:
    """Whether a row has an id and a vector with a direction: no null or non-finite component, not all 0."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(embedding, lambda x: x != 0)
    return F.coalesce(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & fine, F.lit(False))


def unit_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v): the usable rows, with vectors as arrays of doubles of length 1."""
    d = table.where(usable(vec_id, embedding)).select(F.col(vec_id).alias("id"), F.transform(embedding, lambda x: x.cast("double")).alias("v"))
    # Scaled by the largest component first, so that no square over- or underflows.
    d = d.withColumn("_m", F.array_max(F.transform("v", lambda x: F.abs(x)))).withColumn("v", F.transform("v", lambda x: x / F.col("_m")))
    d = d.withColumn("_n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    return d.select("id", F.transform("v", lambda x: x / F.col("_n")).alias("v"))


def _matrix(col: pa.Array | pd.Series) -> np.ndarray:
    if isinstance(col, pd.Series):
        return np.stack(col.to_numpy())
    return np.asarray(col.flatten()).reshape(len(col), -1)


def seed_pairs(vectors: DataFrame, tables: int, parts: int, threshold: float, seed: int, k: int) -> DataFrame:
    """(u, v, s): the best ``k`` neighbours of each vector inside its block of each table."""

    def keys(it):
        for b in it:
            ids, x = b.column("id"), _matrix(b.column("v"))
            out = []
            for t in range(tables):
                h = np.zeros(len(x), np.int64)
                for p in range(parts):
                    q = np.random.default_rng([seed, t, p]).normal(size=(x.shape[1], x.shape[1]))
                    y = x @ q
                    top = np.abs(y).argmax(1)
                    h = h * (2 * x.shape[1]) + top * 2 + (y[np.arange(len(x)), top] > 0)
                out.append(h)
            for t, h in enumerate(out):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t), pa.int32()), pa.array(h), ids, b.column("v")], ["t", "h", "id", "v"])

    keyed = vectors.mapInArrow(keys, "t int, h long, id long, v array<double>")
    # A hot block is cut by a hash of the id: NN-descent bridges what the cut parts.
    sizes = keyed.groupBy("t", "h").agg(F.count("*").alias("n")).where("n > 1")
    cut = keyed.join(sizes, ["t", "h"]).withColumn("c", F.pmod(F.xxhash64("id", "t", F.lit(seed)), F.ceil(F.col("n") / BLOCK)))

    def near(it):
        held: list[pa.RecordBatch] = []
        for b in it:
            held.append(b)
            t = pa.Table.from_batches(held).combine_chunks()
            g = np.stack([t[c].to_numpy() for c in ("t", "h", "c")])
            cuts = np.flatnonzero((g[:, 1:] != g[:, :-1]).any(0)) + 1
            if len(cuts):
                yield from blocks_of(t.slice(0, cuts[-1]), np.concatenate([[0], cuts]))
                t = t.slice(cuts[-1])
            held = t.to_batches()
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from blocks_of(t, np.array([0, len(t)]))

    def blocks_of(t, cuts):
        ids, x, out = t["id"].to_numpy(), _matrix(t["v"].combine_chunks()), []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            s = x[a:b] @ x[a:b].T
            np.fill_diagonal(s, -2)
            m = min(k, b - a - 1)
            best = np.argpartition(-s, m - 1, axis=1)[:, :m]
            i, j = np.nonzero(np.take_along_axis(s, best, 1) >= threshold - 0.25)
            if len(i):
                w = best[i, j]
                out.append((ids[a:b][i], ids[a:b][w], s[i, w]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["u", "v", "s"])

    # One task reads its blocks in order, a block at a time.
    return cut.select("t", "h", "c", "id", "v").repartition("t", "h", "c").sortWithinPartitions("t", "h", "c").mapInArrow(near, "u long, v long, s double")


def best_lists(pairs: DataFrame, k: int) -> DataFrame:
    """(u, v, s): each vector's ``k`` best distinct neighbours, from both directions of every pair."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "s"))
    top = both.groupBy("u", "v").agg(F.max("s").alias("s"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))
    return top.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def descend(vectors: DataFrame, lists: DataFrame, k: int, threshold: float) -> DataFrame:
    """One round of NN-descent: neighbours of neighbours that are new are scored, and lists keep the best.

    ``lists`` has ``fresh``, true for entries that no round has joined yet, and so has the result.
    Pairs are taken from one list and along two lists, as a vector that no list holds has neighbours too.
    """
    a = lists.select(F.col("u").alias("m"), F.col("v").alias("u"), F.col("fresh").alias("_f"))
    b = lists.select(F.col("u").alias("m"), F.col("v").alias("w"), F.col("fresh").alias("_g"))
    c = lists.select("u", F.col("v").alias("m"), F.col("fresh").alias("_f"))
    pairs = a.join(b, "m").where("u < w AND (_f OR _g)").select("u", F.col("w").alias("v"))
    along = c.join(b, "m").where("u <> w AND (_f OR _g)").select(F.least("u", "w").alias("u"), F.greatest("u", "w").alias("v"))
    known = lists.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    fresh = pairs.unionByName(along).distinct().join(known, ["u", "v"], "left_anti")
    x, y = vectors.select(F.col("id").alias("u"), F.col("v").alias("x")), vectors.select(F.col("id").alias("v"), F.col("v").alias("y"))
    scored = fresh.join(x, "u").join(y, "v")

    def dot(it):
        for t in it:
            s = np.einsum("ij,ij->i", _matrix(t.column("x")), _matrix(t.column("y"))) if t.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([t.column("u"), t.column("v"), pa.array(s, pa.float64())], ["u", "v", "s"])

    scored = scored.select("u", "v", "x", "y").mapInArrow(dot, "u long, v long, s double").where(F.col("s") >= threshold - 0.25)
    return renew(lists, best_lists(lists.select("u", "v", "s").unionByName(scored), k))


def renew(old: DataFrame | None, lists: DataFrame) -> DataFrame:
    """``lists`` with ``fresh``: whether the entry is not in ``old``."""
    if old is None:
        return lists.withColumn("fresh", F.lit(True))
    return lists.join(old.select("u", "v", F.lit(False).alias("_o")), ["u", "v"], "left").select("u", "v", "s", F.col("_o").isNull().alias("fresh"))


def converge(vectors: DataFrame, lists: DataFrame, k: int, threshold: float) -> DataFrame:
    """Rounds of NN-descent until one changes no list; it ends, as each change betters a list."""
    while lists.where("fresh").take(1):
        lists = materialize(descend(vectors, lists, k, threshold))
    return lists


def _pairs(table: DataFrame, block: str, blocks: int, *columns: str) -> DataFrame:
    """Every row once for each unordered pair (x, y) of blocks that its own block is in."""
    return table.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least(block, "_o").alias("x"), F.greatest(block, "_o").alias("y"), F.col(block).alias("_i"), *columns)


def across(members: DataFrame, threshold: float, block: int = 512) -> DataFrame:
    """(a, b): components of ``members`` (component, id, v) that a link joins, exact.

    A block of one component has a centre and the largest angle to it.  Two blocks are multiplied
    unless their centres are further apart than both angles and the threshold's.
    """
    size = members.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("_b"))
    m = members.join(size, "component").select("component", F.pmod(F.xxhash64("id", F.lit(13)), F.col("_b")).cast("int").alias("k"), "id", "v")
    m = materialize(m)
    limit = float(np.arccos(threshold)) + 1e-6

    def ball(pdf: pd.DataFrame) -> pd.DataFrame:
        v = _matrix(pdf["v"])
        c = v.mean(0)
        c = c / np.linalg.norm(c) if np.linalg.norm(c) > 1e-9 else v[0]
        return pd.DataFrame({"component": pdf["component"].iloc[:1], "k": pdf["k"].iloc[:1], "c": [c.tolist()], "r": [float(np.arccos(np.clip(v @ c, -1, 1)).max())]})

    balls = materialize(m.groupBy("component", "k").applyInPandas(ball, "component long, k int, c array<double>, r double"))
    blocks = -(-balls.count() // WIDE)
    if not blocks:
        return members.select(F.col("component").alias("a"), F.col("component").alias("b")).limit(0)
    dealt = balls.withColumn("_w", F.pmod(F.xxhash64("component", "k"), F.lit(blocks)).cast("int"))

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
        p, q = (pdf, pdf) if x == y else (pdf[pdf["_i"] == x], pdf[pdf["_i"] == y])
        if not len(p) or not len(q):
            return pd.DataFrame({"a": [], "ka": [], "b": [], "kb": []})
        near = np.arccos(np.clip(_matrix(p["c"]) @ _matrix(q["c"]).T, -1, 1)) <= p["r"].to_numpy()[:, None] + q["r"].to_numpy()[None, :] + limit
        i, j = np.nonzero(near)
        out = pd.DataFrame({"a": p["component"].to_numpy()[i], "ka": p["k"].to_numpy()[i], "b": q["component"].to_numpy()[j], "kb": q["k"].to_numpy()[j]})
        # Inside a component all links are counted anyway; of one block's pairs both orders are found.
        return out[out["a"] < out["b"]] if x == y else out[out["a"] != out["b"]]

    # Every two blocks meet in one pair of wide blocks only.
    todo = materialize(_pairs(dealt, "_w", blocks, "component", "k", "c", "r").groupBy("x", "y").applyInPandas(close, "a long, ka int, b long, kb int"))
    left = todo.select("*", F.col("a").alias("component"), F.col("ka").alias("k"), F.lit(True).alias("_l"))
    right = todo.select("*", F.col("b").alias("component"), F.col("kb").alias("k"), F.lit(False).alias("_l"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        on = pdf["_l"].to_numpy()
        linked = on.any() and not on.all() and (_matrix(pdf["v"][on]) @ _matrix(pdf["v"][~on]).T >= threshold).any()
        return pdf[["a", "b"]].iloc[: int(linked)]

    return left.unionByName(right).join(m, ["component", "k"]).select("a", "ka", "b", "kb", "_l", "v").groupBy("a", "ka", "b", "kb").applyInPandas(meet, "a long, b long").distinct()


def every_link(vectors: DataFrame, threshold: float, n: int, block: int = WIDE) -> DataFrame:
    """(a, b): links that join the same components as all links do, from products of all pairs of blocks.

    The work grows with the square of ``n``; the memory of a task doesn't, and a task emits less than one edge a vector.
    """
    blocks = max(1, -(-n // block))
    spread = _pairs(vectors.withColumn("_w", F.pmod(F.xxhash64("id", F.lit(17)), F.lit(blocks)).cast("int")), "_w", blocks, "id", "v")

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
        own, ids, v = pdf["_i"].to_numpy(), pdf["id"].to_numpy(), _matrix(pdf["v"])
        p, q = np.flatnonzero(own == x), np.flatnonzero(own == y)
        i, j = np.nonzero(v[p] @ v[q].T >= threshold)
        i, j = p[i], q[j]
        label, before = np.arange(len(ids)), None
        while before is None or (label != before).any():
            before = label.copy()
            least = np.minimum(label[i], label[j])
            np.minimum.at(label, i, least)
            np.minimum.at(label, j, least)
            label = label[label]
        on = label != np.arange(len(ids))
        return pd.DataFrame({"a": ids[on], "b": ids[label[on]]})

    return spread.groupBy("x", "y").applyInPandas(forest, "a long, b long")


def audit(spark: SparkSession, vectors: DataFrame, comp: DataFrame, threshold: float, k: int) -> float:
    """Least recall of small and of large groups: means over audited vectors of the share of their links that lie in their component.

    Vectors without a found link count as small groups.
    """
    size = comp.groupBy("component").agg(F.count("*").alias("_n"))
    known = vectors.select("id", "v").join(comp.join(size, "component").select(F.col("node").alias("id"), "component", "_n"), "id", "left")
    known = materialize(known.select("id", "v", F.coalesce("component", "id").alias("c"), (F.coalesce("_n", F.lit(1)) > k + 1).alias("large")))
    chosen = [r for large in (False, True) for r in known.where(F.col("large") == large).orderBy(F.xxhash64("id", F.lit(11)), "id").limit(AUDIT).collect()]
    if not chosen:
        return 1.0
    q = spark.sparkContext.broadcast((np.array([r["id"] for r in chosen]), np.array([r["c"] for r in chosen]), np.array([r["v"] for r in chosen])))

    def scan(it):
        ids, own, x = q.value
        true, found = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for b in it:
            if not b.num_rows:
                continue
            s = (x @ _matrix(b.column("v")).T >= threshold) & (ids[:, None] != np.asarray(b.column("id"))[None, :])
            true += s.sum(1)
            found += (s & (own[:, None] == np.asarray(b.column("c"))[None, :])).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ids))), pa.array(true), pa.array(found)], ["i", "links", "found"])

    sums = known.select("id", "v", "c").mapInArrow(scan, "i long, links long, found long").groupBy("i").agg(F.sum("links").alias("links"), F.sum("found").alias("found")).where("links > 0").collect()
    shares: dict[bool, list[float]] = {}
    for r in sums:
        shares.setdefault(chosen[r["i"]]["large"], []).append(r["found"] / r["links"])
    return min((sum(x) / len(x) for x in shares.values()), default=1.0)


def group_counts(members: DataFrame, threshold: float, block: int = 512) -> DataFrame:
    """(id, n): links of each vector inside its group, from products of blocks of vectors; no pair is emitted.

    ``members`` has component, id, v and copies.
    """
    size = members.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("_b"))
    m = members.join(size, "component").withColumn("_i", F.pmod(F.xxhash64("id", F.lit(13)), F.col("_b")).cast("int"))
    # Every unordered pair of blocks is one task's product.
    spread = m.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1))).select("component", F.least("_i", "_o").alias("x"), F.greatest("_i", "_o").alias("y"), "_i", "id", "v", "copies")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, v, c, own = pdf["id"].to_numpy(), _matrix(pdf["v"]), pdf["copies"].to_numpy(), pdf["_i"].to_numpy()
        x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
        if x == y:
            s = (v @ v.T) >= threshold
            np.fill_diagonal(s, False)
            return pd.DataFrame({"id": ids, "n": s @ c})
        a, b = own == x, own == y
        s = (v[a] @ v[b].T) >= threshold
        return pd.DataFrame({"id": np.concatenate([ids[a], ids[b]]), "n": np.concatenate([s @ c[b], s.T @ c[a]])})

    return spread.groupBy("component", "x", "y").applyInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def vector_components(same: DataFrame, threshold: float, k: int, tables: int, max_rounds: int) -> DataFrame:
    """(node, component) of distinct vectors of one length (id, v, copies)."""
    spark, n = same.sparkSession, same.count()
    width = same.select(F.max(F.size("v"))).first()[0]
    parts = max(1, round(np.log(max(n, 2) / 6) / np.log(2 * width)))
    lists, vectors = None, same.select("id", "v")
    for r in range(max_rounds):
        found = seed_pairs(vectors, tables * (r + 1), parts, threshold, 100 + r, k)
        found = best_lists(found if lists is None else lists.select("u", "v", "s").unionByName(found), k)
        lists = converge(vectors, materialize(renew(lists, found)), k, threshold)
        links = lists.where(F.col("s") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b"))
        comp = connected_components(links)
        # A link that two saturated lists both leave out can join two components: full lists are enlarged to all of their group.
        full = lists.where(F.col("s") >= threshold).groupBy("u").count().where(F.col("count") >= k).select(F.col("u").alias("id"))
        joined = materialize(across(comp.withColumnRenamed("node", "id").join(full, "id").join(vectors, "id").select("component", "id", "v"), threshold))
        if joined.take(1):
            comp = connected_components(links.unionByName(joined))
        if audit(spark, same, comp, threshold, k) >= ENOUGH:
            return comp
    return connected_components(every_link(vectors, threshold, n))


def near_duplicates(spark: SparkSession, table: DataFrame, threshold: float = 0.9, k: int = LIST, tables: int = 16, max_rounds: int = 3) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``table`` (vec_id long, embedding).

    Rows that are not ``usable`` link with nothing.  Each row is a vector of its own: rows with equal
    vectors link with each other, rows that share an id have their own links, and vectors of different
    lengths link with nothing of each other.  Other columns are not read; an empty table gives an empty one.
    """
    every = table.select("vec_id", "embedding")
    rows = materialize(unit_vectors(every))
    same = rows.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    same = materialize(same.withColumn("id", F.xxhash64("v")))
    comp = None
    for width in sorted(r[0] for r in same.select(F.size("v")).distinct().collect()):
        one = vector_components(same.where(F.size("v") == width).select("id", "v", "copies"), threshold, k, tables, max_rounds)
        comp = one if comp is None else comp.unionByName(one)
    rest = every.where(~usable("vec_id", "embedding")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if comp is not None:
        members = same.join(comp.withColumnRenamed("node", "id"), "id").select("component", "id", "v", "copies", "least")
        counts = group_counts(members.drop("least"), threshold)
        least = members.groupBy("component").agg(F.min("least").alias("component_id"))
        found = members.select("component", "id").join(least, "component").join(counts, "id", "left").select("id", "component_id", "n")
        per = same.select("id", "v", "copies", "least").join(found, "id", "left")
        per = per.select("v", F.coalesce("component_id", "least").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        rest = rows.join(per, "v").select(F.col("id").alias("vec_id"), "n_links", "component_id").unionByName(rest)
    return rest.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def embedding_query(spark: SparkSession, table: DataFrame) -> DataFrame:
    return near_duplicates(spark, table)
