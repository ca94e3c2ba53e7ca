"""Sources and sinks: metric matrices, event rows, adjacency matrices, results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spark_rca.operators.lineage import cut


def melt_matrix(wide: DataFrame, name: str, samples: list[str], incident: str = "m", row: str | None = None) -> DataFrame:
    """Rows of a service matrix (name, sample columns) to the long table; empty cells are 0 (missing).

    Services are numbered by the rank of their name or, with ``row``, by that column, the number of their row; names may then repeat.
    Only names are numbered in one task, never samples.
    """
    cells = F.posexplode(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in samples]))
    if row is not None:
        long = wide.select(F.col(row).cast("int").alias("service_id"), cells.alias("t", "value"))
    else:
        ids = wide.select(name).distinct().withColumn("service_id", F.rank().over(Window.orderBy(name)).cast("int"))
        long = wide.select(F.col(name), cells.alias("t", "value")).join(ids, name)
    return long.select(F.lit(incident).alias("incident_id"), "service_id", F.col("t").cast("long").alias("t"), "value")


def numbered_rows(wide: DataFrame) -> DataFrame:
    """A table as read from files, with ``_row``, the number of each row from 1 in the order of files and of rows in a file.

    Rows are sorted by file, block and place; each partition then counts from the rows of those before it.  Nothing but a count of each
    partition is joined.
    """
    at = wide.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_place": F.monotonically_increasing_id()})
    placed = cut(at.sort("_file", "_block", "_place").withColumn("_part", F.spark_partition_id()))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", before)
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_file", "_block", "_place"))
    return placed.withColumn("_in", inside).join(sizes, "_part").withColumn("_row", F.col("_before") + F.col("_in")).select(*wide.columns, "_row")


def read_metric_matrix(spark: SparkSession, path: str, fmt: str, samples: list[str], name: str = "name", incident: str = "m", by_row: bool = False) -> DataFrame:
    """CSV (without header) or Parquet with one row per service: its name, then its samples.

    With ``by_row`` a service's number is that of its row, from 1, as lists of causes by row want it; else the rank of its name.
    """
    schema = ", ".join([f"{name} string", *[f"{c} double" for c in samples]])
    wide = spark.read.schema(schema).format(fmt).load(path)
    return melt_matrix(numbered_rows(wide), name, samples, incident, "_row") if by_row else melt_matrix(wide, name, samples, incident)


def metrics_from_events(events: DataFrame, incident: Column, service: Column, t: Column, value: Column, digits: int = 2) -> DataFrame:
    """Sum events into a dense grid per incident: every service at every t from 0 to the incident's last; empty cells are 0.

    Partial sums run before the shuffle; the grid is one row per service, exploded after the join.
    """
    e = events.select(incident.alias("incident_id"), service.cast("int").alias("service_id"), t.cast("long").alias("t"), value.alias("value"))
    cells = e.groupBy("incident_id", "service_id", "t").agg(F.round(F.sum("value"), digits).alias("value"))
    last = cells.groupBy("incident_id").agg(F.max("t").alias("_hi"))
    grid = cells.select("incident_id", "service_id").distinct().join(last, "incident_id")
    grid = grid.select("incident_id", "service_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_hi"))).alias("t"))
    return grid.join(cells, ["incident_id", "service_id", "t"], "left").select("incident_id", "service_id", "t", F.coalesce("value", F.lit(0.0)).alias("value"))


def melt_adjacency(wide: DataFrame, src: Column, cells: list[Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """Matrix rows to edges (keys, src, dst, weight) with weight other than 0; dst is the 1-based column."""
    long = wide.select(*keys, src.cast("int").alias("src"), F.posexplode(F.array(*[c.cast("double") for c in cells])).alias("_p", "weight"))
    return long.where("weight <> 0").select(*keys, "src", (F.col("_p") + 1).cast("int").alias("dst"), "weight")


def read_adjacency(spark: SparkSession, path: str, nodes: int, keys: tuple[str, ...] = (), header: bool = False) -> DataFrame:
    """Edges of N x N CSV matrices: columns ``keys``, if any, tell the matrix of a row, the next is the row's node id, then its N weights.

    Several matrices may share files and their rows may come in any order; ``header`` skips a first line, as ``write_matrix`` writes it.
    """
    names = [f"d{i}" for i in range(1, nodes + 1)]
    schema = [*[f"{k} string" for k in keys], "src int", *[f"{n} double" for n in names]]
    wide = spark.read.schema(", ".join(schema)).csv(path, header=header)
    return melt_adjacency(wide, F.col("src"), [F.col(n) for n in names], keys)


def edge_matrix(edges: DataFrame, nodes: Sequence[int], keys: tuple[str, ...] = ("incident_id",)) -> DataFrame:
    """Edge list to matrix rows: src, then one column d<id> for each node; absent edges are 0."""
    wide = edges.groupBy(*keys, "src").pivot("dst", list(nodes)).agg(F.first("weight"))
    return wide.select(*keys, "src", *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(f"d{n}") for n in nodes])


def write_matrix(edges: DataFrame, nodes: list[int], path: str) -> None:
    edge_matrix(edges, nodes).write.mode("overwrite").csv(path, header=True)


def series_digests(metrics: DataFrame) -> DataFrame:
    """(incident_id, digest): a fingerprint of all samples of an incident, whatever their order; one narrow aggregate."""
    h = F.xxhash64("service_id", "t", "value")
    parts = metrics.groupBy("incident_id").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"))
    return parts.select("incident_id", F.concat_ws("-", F.hex("n"), F.hex("x"), F.col("s").cast("string")).alias("digest"))


def save_intervals(intervals: DataFrame, path: str) -> None:
    """Keep results with a ``params_id``, in place of what was kept of the same parameter sets before."""
    intervals.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("params_id").parquet(path)


def save_tests(intervals: DataFrame, incidents: DataFrame, path: str, params_id: str) -> None:
    """Keep the interval tests of ``incidents`` (incident_id, digest) under a parameter set, for reuse by other runs.

    Each incident leaves a row without x as well, so that one without results counts as done.  A save is a
    partition of its own, named by what it holds: a job that is tried again overwrites its own rows.
    """
    done = incidents.select("incident_id", "digest")
    run = done.agg(F.count("*"), F.bit_xor(F.xxhash64("incident_id", "digest"))).first()
    rows = intervals.join(done, "incident_id")
    marks = done.select(*[F.col(c) if c in done.columns else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    rows = rows.unionByName(marks).withColumn("params_id", F.lit(params_id)).withColumn("run", F.lit(f"{run[0]}_{(run[1] or 0) & (2**64 - 1):x}"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("params_id", "run").parquet(path)


def _stored(spark: SparkSession, path: str, params_id: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path).where(F.col("params_id") == params_id)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def has_intervals(spark: SparkSession, path: str, params_id: str) -> bool:
    """Whether a finished run has left interval results of this parameter set, of any incident."""
    kept = _stored(spark, path, params_id)
    return kept is not None and bool(kept.take(1))


def missing_incidents(spark: SparkSession, path: str, params_id: str, incidents: DataFrame) -> DataFrame:
    """Those of ``incidents`` (incident_id, digest) whose very samples no finished run has tested with these parameters."""
    kept = _stored(spark, path, params_id)
    return incidents if kept is None else incidents.join(kept.where("x IS NULL").select("incident_id", "digest"), ["incident_id", "digest"], "left_anti")


def load_intervals(spark: SparkSession, path: str, params_id: str, incidents: DataFrame | None = None) -> DataFrame:
    """Results of a parameter set, of ``incidents`` (incident_id, digest) if given.  Tests that two runs have saved at once count once."""
    kept = _stored(spark, path, params_id)
    if kept is None:
        raise ValueError(f"nothing is stored in {path}")
    if "run" not in kept.columns:
        return kept
    first = kept.where("x IS NULL").groupBy("incident_id", "digest").agg(F.min("run").alias("run"))
    if incidents is not None:
        first = first.join(incidents.select("incident_id", "digest"), ["incident_id", "digest"], "left_semi")
    return kept.where("x IS NOT NULL").join(first, ["incident_id", "digest", "run"], "left_semi").drop("run", "digest")


def append_results(*results: DataFrame) -> DataFrame:
    """Result rows of several methods in one table; rows without accuracy (0 or less) are not exported."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.where("acc > 0")
