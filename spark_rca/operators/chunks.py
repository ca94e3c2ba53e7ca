"""Series operators over ranges of t, so that no task holds a series: windows with a halo, fills with carried edges, moments by sums.

For series of any length with one sample at every t from the first to the last; others are refused with an error.
Results are those of the window operators without chunks, which take one task a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spark_rca.operators.prepare import SERIES

#: Samples of a range.
CHUNK = 1_000_000


def _ranged(metrics: DataFrame, chunk: int, back: int = 0) -> DataFrame:
    """Rows with the first and last t of their series and their range ``_c``, once for each range whose halo of ``back`` samples before it they are in."""
    ends = metrics.groupBy(*SERIES).agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"), F.count("*").alias("_n"))
    whole = F.col("_n") == F.col("_hi") - F.col("_lo") + 1
    refused = F.raise_error(F.concat(F.lit("holes or repeated samples in series "), F.col("incident_id"), F.lit(" "), F.col("service_id").cast("string")))
    ends = ends.select(*SERIES, F.when(whole, F.col("_lo")).otherwise(refused.cast("long")).alias("_lo"), "_hi")
    d = metrics.join(ends, list(SERIES))
    return d.withColumn("_c", F.explode(F.sequence(F.floor(F.col("t") / chunk), F.least(F.floor((F.col("t") + back) / chunk), F.floor(F.col("_hi") / chunk)))))


def _trailing(metrics: DataFrame, chunk: int, w: int, agg: Column) -> DataFrame:
    """The aggregate of the last ``w`` samples as ``_v``, and how many samples the series has up to each as ``_i``."""
    o = Window.partitionBy(*SERIES, "_c").orderBy("t").rowsBetween(-(w - 1), 0)
    d = _ranged(metrics, chunk, w - 1).withColumn("_v", agg.over(o))
    return d.where(F.floor(F.col("t") / chunk) == F.col("_c")).withColumn("_i", F.col("t") - F.col("_lo") + 1)


def rolling_mean(metrics: DataFrame, w: int, chunk: int = CHUNK) -> DataFrame:
    d = _trailing(metrics, chunk, w, F.avg("value"))
    return d.select(*metrics.columns, F.when(F.col("_i") >= w, F.col("_v")).otherwise(0.0).alias("mean"))


def rolling_std(metrics: DataFrame, w: int, chunk: int = CHUNK) -> DataFrame:
    d = _trailing(metrics, chunk, w, F.stddev_pop("value"))
    return d.select(*metrics.columns, F.when((F.col("_i") >= w) & (F.col("t") < F.col("_hi")), F.col("_v")).otherwise(0.0).alias("std"))


def back_mean(metrics: DataFrame, d: int, chunk: int = CHUNK) -> DataFrame:
    return _trailing(metrics, chunk, d, F.avg("value")).where(F.col("_i") >= d).select(*SERIES, "t", F.col("_v").alias("mean"))


def fill_zeros(metrics: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The last value other than 0, else the next, else 0: within a range by a window, beyond it from what the other ranges end and begin with."""
    d = metrics.withColumn("_c", F.floor(F.col("t") / chunk))
    known = F.when(F.col("value") != 0, F.col("value"))
    at = F.when(F.col("value") != 0, F.col("t"))
    edge = d.groupBy(*SERIES, "_c").agg(F.min_by(known, at).alias("_first"), F.max_by(known, at).alias("_last"))
    o = Window.partitionBy(*SERIES).orderBy("_c")  # a row per range
    before = F.last("_last", True).over(o.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_first", True).over(o.rowsBetween(1, Window.unboundedFollowing))
    edge = edge.select(*SERIES, "_c", "_first", before.alias("_before"), after.alias("_after"))
    own = F.last(known, True).over(Window.partitionBy(*SERIES, "_c").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    out = d.withColumn("_own", own).join(edge, [*SERIES, "_c"])
    return out.withColumn("value", F.coalesce("_own", "_before", "_first", "_after", F.lit(0.0))).select(*metrics.columns)


def zscore(metrics: DataFrame) -> DataFrame:
    """Population z-score; mean and deviation come from partial sums, not from a window over the series."""
    m = metrics.groupBy(*SERIES).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    d = metrics.join(m, list(SERIES))
    return d.withColumn("value", (F.col("value") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s"))).select(*metrics.columns)
