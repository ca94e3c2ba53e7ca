"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spark_rca.llm.common import free_names

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size", weights: tuple[int, ...] = (1, 2, 3), max_rate: float = 3.0) -> DataFrame:
    """One row per source with its ``source_size``, ``target`` and ``rate`` (target over size).

    Sources in code point order, null last, take the weights in turn.  All sizes together are shared
    by weight; a source gets at most ``max_rate`` times its size and the excess is shared again by
    weight.  With r = cap / weight ascending, a source is capped exactly if its r is at most the
    level that the sources from it on would share, so running sums give the fixed point without a
    loop.  Sources of size 0 have target and rate 0.  Only the aggregated source table is sorted.
    """
    per = sizes.groupBy(source).agg(F.sum(size).cast("long").alias("source_size"))
    order = Window.orderBy(F.col(source).asc_nulls_last())
    ring = F.array(*[F.lit(int(w)) for w in weights])
    per = per.withColumn("_w", F.element_at(ring, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    cap = F.col("source_size") * F.lit(float(max_rate))
    everyone = Window.partitionBy()
    before = Window.orderBy((cap / F.col("_w")).asc(), F.col(source).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    per = (
        per.withColumn("_all", F.sum("source_size").over(everyone))
        .withColumn("_weights", F.sum("_w").over(everyone))
        .withColumn("_sum", F.coalesce(F.sum("source_size").over(before), zero))
        .withColumn("_wsum", F.coalesce(F.sum("_w").over(before), zero))
    )
    level = (F.col("_all") - F.col("_sum") * F.lit(float(max_rate))) / (F.col("_weights") - F.col("_wsum"))
    per = per.withColumn("_capped", cap / F.col("_w") <= level)
    done = F.sum(F.when(F.col("_capped"), F.col("source_size")).otherwise(0)).over(everyone)
    done_w = F.sum(F.when(F.col("_capped"), F.col("_w")).otherwise(0)).over(everyone)
    shared = (F.col("_all") - done * F.lit(float(max_rate))) / (F.col("_weights") - done_w) * F.col("_w")
    per = per.withColumn("target", F.when(F.col("source_size") == 0, 0.0).when(F.col("_capped"), cap).otherwise(shared))
    rate = F.when(F.col("source_size") == 0, 0.0).otherwise(F.col("target") / F.col("source_size"))
    return per.withColumn("rate", F.least(rate, F.lit(float(max_rate)))).select(source, "source_size", "target", "rate")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from 32 bits of an MD5 digest of seed and key: the same on every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


#: What ``mix_sources`` adds.
ADDED = ("_size", "_source_size", "_target", "_copies")


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_rate: float = 3.0, seed: int = 9, names: tuple[str, str, str, str] = ADDED) -> DataFrame:
    """``docs`` with columns called ``names``: its size, its source's size and target, and how often it is taken.

    A document is taken floor(rate) times, once more if its hash-seeded uniform number is below the
    fraction.  Null texts have size 0; repeated rows take the same decision; a null id hashes as an
    empty string; an empty table gives an empty one.  Other columns stay as they are; those called ``names`` are replaced.  The source table joins as a shuffle join whose
    one hot key AQE splits, or as a broadcast where Spark has measured it as small.
    """
    size_, source_size, target, copies = names
    docs = docs.select([c for c in docs.columns if c not in names])
    own, rate = free_names(docs, "own", "rate")
    sized = docs.withColumn(size_, word_count(F.col(text)))
    per = source_targets(sized.select(F.col(source).alias("s"), F.col(size_).alias("size")), "s", "size", weights, max_rate)
    per = per.select(F.col("s").alias(own), F.col("source_size").alias(source_size), F.col("target").alias(target), F.col("rate").alias(rate))
    out = sized.join(per, F.col(source).eqNullSafe(F.col(own)), "left").drop(own)
    extra = (uniform(F.col(doc_id), seed) < F.col(rate) - F.floor(rate)).cast("int")
    return out.withColumn(copies, (F.floor(rate) + extra).cast("int")).drop(rate)


def emit_copies(mixed: DataFrame, copies: str = "_copies") -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    (one,) = free_names(mixed, "copy")
    return mixed.withColumn(one, F.explode(F.sequence(F.lit(1), F.greatest(F.col(copies), F.lit(1))))).where(F.col(copies) > 0).drop(one)


def mix_stage(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the mix of ``docs``, with their columns unchanged."""
    names = tuple(free_names(docs, *(n.lstrip("_") for n in ADDED)))
    return emit_copies(mix_sources(docs, names=names), names[3]).select(docs.columns)


def mix_query(docs: DataFrame) -> DataFrame:
    m = mix_sources(docs.select("doc_id", "text", "source"))
    return m.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def sql(docs: str = "documents") -> str:
    """The same mix in DuckDB: doc_id, size, source_size, target, taken and copies."""
    return rf"""
    WITH d AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {docs}),
    p0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    p1 AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM p0),
    p2 AS (SELECT *, source_size * 3.0::DOUBLE AS cap, (sum(source_size) OVER ())::BIGINT AS total, (sum(w) OVER ())::BIGINT AS weights,
             coalesce(sum(source_size) OVER o, 0)::BIGINT AS before_size, coalesce(sum(w) OVER o, 0)::BIGINT AS before_w
           FROM p1 WINDOW o AS (ORDER BY (source_size * 3.0::DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    p3 AS (SELECT *, cap / w <= (total - before_size * 3.0::DOUBLE) / (weights - before_w) AS capped FROM p2),
    p4 AS (SELECT *, coalesce(sum(source_size) FILTER (capped) OVER (), 0)::BIGINT AS done, coalesce(sum(w) FILTER (capped) OVER (), 0)::BIGINT AS done_w FROM p3),
    p5 AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN capped THEN cap
             ELSE (total - done * 3.0::DOUBLE) / (weights - done_w) * w END AS target FROM p4),
    p6 AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(target / source_size, 3.0::DOUBLE) END AS rate FROM p5)
    SELECT d.*, p6.source_size, p6.target,
      (floor(rate) + (('0x' || substr(md5('9:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate))::INT)::INT AS copies
    FROM d JOIN p6 ON d.source IS NOT DISTINCT FROM p6.source"""


MIX_SQL = f"SELECT doc_id, size, source_size, target, size * copies AS taken FROM ({sql()})"
