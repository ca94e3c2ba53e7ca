"""Window operators on series, edges and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spark_rca.operators.prepare import SERIES, series


def rolling_mean(metrics: DataFrame, w: int) -> DataFrame:
    """Trailing mean over w rows; 0 for the first w - 1."""
    o = series()
    m = F.avg("value").over(o.rowsBetween(-(w - 1), 0))
    return metrics.withColumn("mean", F.when(F.row_number().over(o) >= w, m).otherwise(0.0))


def rolling_std(metrics: DataFrame, w: int) -> DataFrame:
    """Trailing population deviation over w rows; the first w - 1 and the last row are 0."""
    o = series()
    s = F.stddev_pop("value").over(o.rowsBetween(-(w - 1), 0))
    last = F.lead("t").over(o).isNull()
    return metrics.withColumn("std", F.when((F.row_number().over(o) >= w) & ~last, s).otherwise(0.0))


def back_mean(metrics: DataFrame, d: int) -> DataFrame:
    """Trailing mean over d rows, full windows only."""
    o = series()
    out = metrics.select(*SERIES, "t", F.avg("value").over(o.rowsBetween(-(d - 1), 0)).alias("mean"), F.row_number().over(o).alias("_i"))
    return out.where(F.col("_i") >= d).drop("_i")


def normalize(edges: DataFrame, by: str = "dst") -> DataFrame:
    """Weights over their column's (dst) or row's (src) sum; sums of 0 are left as they are."""
    s = F.sum("weight").over(Window.partitionBy("incident_id", by))
    return edges.withColumn("weight", F.when(s != 0, F.col("weight") / F.when(s != 0, s)).otherwise(F.col("weight")))


def adaptive_threshold(edges: DataFrame, ratio: float) -> DataFrame:
    """Of each source, the edges of at least ``ratio`` of its largest weight; weight 0 is no edge."""
    m = F.max("weight").over(Window.partitionBy("incident_id", "src"))
    return edges.withColumn("_m", m).where((F.col("weight") >= ratio * F.col("_m")) & (F.col("weight") > 0)).drop("_m")


def static_threshold(edges: DataFrame, least: float) -> DataFrame:
    return edges.where((F.col("weight") >= least) & (F.col("weight") > 0))


def instant_threshold(curves: DataFrame, t: int, ratio: float) -> DataFrame:
    """Adaptive threshold on the curves' values at one t."""
    at = curves.where(F.col("t") == t).select("incident_id", F.col("x").alias("src"), F.col("y").alias("dst"), F.col("cnt").cast("double").alias("weight"))
    return adaptive_threshold(at, ratio)


def normalize_curves(curves: DataFrame) -> DataFrame:
    m = F.max("cnt").over(Window.partitionBy("incident_id", "x", "y"))
    return curves.withColumn("level", F.when(m > 0, F.col("cnt") / F.when(m > 0, m)).otherwise(0.0))


def _islands(inside: DataFrame) -> DataFrame:
    key = ["incident_id", "x", "y"]
    i = F.row_number().over(Window.partitionBy(*key).orderBy("t"))
    g = inside.withColumn("_g", F.col("t") - i).groupBy(*key, "_g").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("end"))
    return g.drop("_g")


def islands_over(curves: DataFrame, threshold: float) -> DataFrame:
    """Maximal runs [start, end) of t with a count over the threshold."""
    return _islands(curves.where(F.col("cnt") > threshold))


def islands_at_max(curves: DataFrame) -> DataFrame:
    """Runs where the count is its pair's maximum, if that is over 0."""
    m = F.max("cnt").over(Window.partitionBy("incident_id", "x", "y"))
    return _islands(curves.withColumn("_m", m).where("cnt = _m AND _m > 0").drop("_m"))


def order_stat(metrics: DataFrame, level: float) -> DataFrame:
    """The value at sorted index int(level * n), counted from 0."""
    w = Window.partitionBy(*SERIES)
    d = metrics.withColumn("_i", F.row_number().over(w.orderBy("value"))).withColumn("_n", F.count("*").over(w))
    return d.where(F.col("_i") == F.least(F.floor(F.col("_n") * level), F.col("_n") - 1) + 1).select(*SERIES, "value")
