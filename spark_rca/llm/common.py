"""Tables, shared-storage checkpoints and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}
#: Folders of the tables that ``materialize_alone`` deletes, innermost last.
_PASSING: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, in local sessions only (tests), a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found or _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-checkpoint-"))


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, so that lost executors lose no work."""
    spark = df.sparkSession
    path = f"{_PASSING[-1] if _PASSING else shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def materialize_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` as such a table; the tables that were materialized on the way there are deleted after it is written."""
    folder = f"{_PASSING[-1] if _PASSING else shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    _PASSING.append(folder)
    try:
        df = make()
    finally:
        _PASSING.pop()
    out = materialize(df)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


#: What a Python worker keeps between the tasks of one operator, by operator and name.
_KEPT: dict[tuple[str, str], object] = {}


def keep(operator: str, name: str, make):
    """``make()``, once per worker until it runs a task of another operator."""
    if (operator, name) not in _KEPT:
        _KEPT[operator, name] = make()
    return _KEPT[operator, name]


def lean(run, operator: str = ""):
    """``run`` for mapInArrow, with what its task has freed given back at the end: Python workers are reused by later stages.

    What other operators ``keep`` in this worker goes first.
    """

    def task(it):
        from spark_rca.llm import common  # the worker's own, not a copy sent with the function

        for key in [k for k in common._KEPT if k[0] != operator]:
            del common._KEPT[key]
        yield from run(it)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim is not None:
            trim(0)

    return task


#: Rows of a few longs that may be broadcast; larger tables join by a shuffle.
BROADCAST_ROWS = 1_000_000


def small_side(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``table`` (written already, narrow) with a broadcast hint if a count proves it has at most ``rows`` rows."""
    return F.broadcast(table) if table.count() <= rows else table


def row_key() -> Column:
    """A 64-bit key of (doc_id, text); rows that agree in both are interchangeable."""
    return F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1).cast("long")), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes not to be a column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        n = f"_{n}"
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


#: Edges that one task contracts before the rounds.
TASK_EDGES = 500_000


def _forest(it):
    """Each node of a task's edges with the least node that it reaches there."""
    up: dict[int, int] = {}

    def find(i: int) -> int:
        while up.setdefault(i, i) != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for b in it:
        for x, y in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    out = [(i, r) for i in up if (r := find(i)) != i]
    for a in range(0, len(out), 100_000):
        u, v = zip(*out[a : a + 100_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    ``edges`` has long columns ``a`` and ``b``; loops, repeated edges and nulls are ignored and an
    empty table gives an empty one.  Tasks first shrink ``TASK_EDGES`` edges each to a spanning forest,
    which settles a small table.  Then rounds alternate large-star and small-star steps (Kiveris et al., 2014): each is an aggregate and a join, no neighbourhood is ever collected, and every round is
    written to the shared folder.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    parts = -(-e.count() // TASK_EDGES)
    e, before = materialize(e.coalesce(max(1, parts)).mapInArrow(_forest, "u long, v long")), None
    while parts > 1:  # at most about log2(nodes) squared rounds
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        kept = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(kept.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
