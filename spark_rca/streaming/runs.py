"""Streams as jobs: they take what has come, write it exactly once, and end; the next run goes on from the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Where a stream's job keeps its files under its folder.
SINK, CHECKPOINT, MARKS = "rows", "checkpoint", "marks"


def drain(rows: DataFrame, folder: str) -> int:
    """Append all that a streaming DataFrame has by now to ``folder``; returns how many (partial) rows its watermark dropped as late."""
    q = rows.writeStream.format("parquet").option("path", f"{folder}/{SINK}").option("checkpointLocation", f"{folder}/{CHECKPOINT}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(op.numRowsDroppedByWatermark for p in q.recentProgress for op in p.stateOperators)


def read_sink(spark: SparkSession, folder: str) -> DataFrame:
    """What all runs have written to ``folder``, without what a failed try has left."""
    return spark.read.parquet(f"{folder}/{SINK}")


class EventJob:
    """An event-time job over the files of ``source`` (a folder or pattern): ``run`` takes new files, ``close`` ends all windows.

    ``transform`` makes the streaming rows from events and sets their watermark on ``ts``; the folder has
    to be one that driver and executors share.  A window is written when the watermark has passed its end, so ``close``
    sends one event of a far later time through the stream; it belongs to no window that is ever written.
    """

    def __init__(self, spark: SparkSession, source: str, schema: StructType, folder: str, transform: Callable[[DataFrame], DataFrame], ts: str = "ts"):
        self.spark, self.folder, self.ts, self.schema = spark, folder, ts, schema
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{MARKS}")
        # Each path is a pattern: a stream takes single files by patterns only.
        streams = [spark.readStream.schema(schema).parquet(path) for path in (source[:-1] + f"[{source[-1]}]", f"{folder}/{MARKS}")]
        events = streams[0].unionByName(streams[1]).withColumn(ts, F.expr(f"cast(cast({ts} AS string) || ' UTC' AS timestamp)") if schema[ts].dataType.typeName() == "timestamp_ntz" else F.col(ts))
        self.rows, self.late = transform(events), 0

    def run(self) -> DataFrame:
        self.late += drain(self.rows, self.folder)
        return read_sink(self.spark, self.folder)

    def close(self, at: str = "9999-01-01 00:00:00") -> DataFrame:
        mark = self.spark.range(1).select(*[(F.lit(at) if f.name == self.ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema])
        mark.write.mode("append").parquet(f"{self.folder}/{MARKS}")
        return self.run()
