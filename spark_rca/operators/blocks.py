"""Dealing all pairs of an incident's series as pairs of blocks: a series is sent once per block, not once per other series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spark_rca.operators.prepare import SERIES


def block_pairs(series: DataFrame, keys: DataFrame, block: int) -> DataFrame:
    """Rows of ``series`` with ``_b``, the block of ``block`` services that theirs is in, once for every pair (``_p`` <= ``_q``) of blocks it is one of.

    ``keys`` (incident_id, service_id) are all series; only these narrow rows are numbered within their incident.
    """
    inc = Window.partitionBy("incident_id")
    number = F.row_number().over(inc.orderBy("service_id")) - 1
    of = keys.select(*SERIES).distinct().withColumn("_b", F.floor(number / block).cast("int")).withColumn("_last", F.max("_b").over(inc))
    d = series.join(of, list(SERIES)).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_last"))))
    return d.withColumn("_p", F.least("_b", "_o")).withColumn("_q", F.greatest("_b", "_o")).drop("_o", "_last")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over all shuffle partitions, for groups whose work exceeds their size: adaptive execution would put small tables in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
