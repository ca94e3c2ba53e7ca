"""Projections, filters and preparation of series.

Window operators share one layout, (incident_id, service_id) ordered by t, so chains of them
shuffle once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("incident_id", "service_id")


def series(*keys: str):
    return Window.partitionBy(*(keys or SERIES)).orderBy("t")


def bucket_sum(metrics: DataFrame, n: int, compat: bool = False) -> DataFrame:
    """Sums of n consecutive samples in floor(T / n) buckets; the rest of the series is dropped.

    ``compat`` keeps a known quirk: the first bucket sums samples 1..n instead of 0..n-1.
    """
    if n == 1:
        return metrics
    whole = metrics.withColumn("_T", F.max("t").over(Window.partitionBy(*SERIES)) + 1)
    b = F.floor(F.col("t") / n)
    plain = whole.where(b < F.floor(F.col("_T") / n)).select(*SERIES, b.alias("b"), "value")
    if compat:
        first = whole.where((F.col("t") >= 1) & (F.col("t") <= n) & (F.col("_T") > n)).select(*SERIES, F.lit(0).cast("long").alias("b"), "value")
        plain = plain.where("b > 0").unionByName(first)
    return plain.groupBy(*SERIES, F.col("b").alias("t")).agg(F.sum("value").alias("value"))


def zero_counts(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy(*SERIES).agg(F.count_if(F.col("value") == 0).alias("zeros"))


def _neighbours() -> tuple[Column, ...]:
    """The nearest known sample at or before, and at or after, each one.

    The second runs backwards in time: a frame that ends at the series' end would be read anew for each row.
    """
    known = F.last(F.when(F.col("value") != 0, F.struct("t", "value")), ignorenulls=True)
    back = series().rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*SERIES).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    return known.over(back), known.over(ahead)


def fill_zeros(metrics: DataFrame, method: str = "prevlatter") -> DataFrame:
    """Zeros are missing values.

    prevlatter: the last value, else the next, else 0.  previous, next: NULL where there is none.
    nearest: the closer neighbour, the earlier in a tie.  linear (slinear): between neighbours, and
    beyond the ends on the line of the two outermost points; zero is the same as previous.  quadratic
    and cubic are splines, in ``fill_spline``.
    """
    prev, nxt = _neighbours()
    d = metrics.withColumn("_p", prev).withColumn("_n", nxt)
    pv, nv = F.col("_p.value"), F.col("_n.value")
    if method == "prevlatter":
        return d.withColumn("value", F.coalesce(pv, nv, F.lit(0.0))).drop("_p", "_n")
    if method in ("previous", "zero"):
        return d.withColumn("value", pv).drop("_p", "_n")
    if method == "next":
        return d.withColumn("value", nv).drop("_p", "_n")
    pt, nt = F.col("_p.t"), F.col("_n.t")
    if method == "nearest":
        near = F.when(pt.isNull(), nv).when(nt.isNull(), pv).when(F.col("t") - pt <= nt - F.col("t"), pv).otherwise(nv)
        return d.withColumn("value", near).drop("_p", "_n")
    if method not in ("linear", "slinear"):
        raise ValueError(f"unknown method {method!r}")
    everyone = Window.partitionBy(*SERIES)
    known = F.when(F.col("value") != 0, F.col("t"))
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy(*SERIES, F.col("value") != 0).orderBy("t"))).withColumn("_m", F.count(known).over(everyone))
    at = lambda k: F.max(F.when((F.col("value") != 0) & (F.col("_k") == k), F.struct("t", "value"))).over(everyone)
    d = d.withColumn("_a", at(1)).withColumn("_b", at(2)).withColumn("_y", at(F.col("_m") - 1)).withColumn("_z", at(F.col("_m")))

    def line(u, v):
        return F.col(f"{u}.value") + (F.col(f"{v}.value") - F.col(f"{u}.value")) * (F.col("t") - F.col(f"{u}.t")) / (F.col(f"{v}.t") - F.col(f"{u}.t"))

    inside = F.when(pt == nt, pv).otherwise(pv + (nv - pv) * (F.col("t") - pt) / F.when(nt != pt, nt - pt))
    out = F.when(F.col("_m") < 2, F.coalesce(pv, nv, F.lit(0.0))).when(pt.isNull(), line("_a", "_b")).when(nt.isNull(), line("_y", "_z")).otherwise(inside)
    return d.withColumn("value", out).select(*metrics.columns)


def zscore(metrics: DataFrame) -> DataFrame:
    """Population z-score of each series; NULL for a constant series."""
    w = Window.partitionBy(*SERIES)
    sd = F.stddev_pop("value").over(w)
    return metrics.withColumn("value", (F.col("value") - F.avg("value").over(w)) / F.when(sd > 0, sd))


def slice_incident(metrics: DataFrame, starts: DataFrame, bef: int, aft: int, clamp: bool = True) -> DataFrame:
    """t in [start - bef, start + aft); clamped to [0, T - 1), which never uses the last sample."""
    last = metrics.groupBy("incident_id").agg(F.max("t").alias("_last"))
    d = metrics.join(starts.select("incident_id", F.col("t").alias("_start")).join(last, "incident_id"), "incident_id")
    lo, hi = F.col("_start") - bef, F.col("_start") + aft
    if clamp:
        lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, F.col("_last"))
    return d.where((F.col("t") >= lo) & (F.col("t") < hi)).drop("_start", "_last")


def centred_windows(metrics: DataFrame, center: int, lens: list[int]) -> DataFrame:
    """Windows of several lengths around one centre, clamped to the series; a window's rows carry its start and length."""
    last = metrics.groupBy("incident_id").agg(F.max("t").alias("_last"))
    start = F.greatest(F.lit(0), (F.lit(center) - F.floor(F.col("window_len") / 2)).cast("long"))
    w = last.select("incident_id", "_last", F.explode(F.array(*[F.lit(n).cast("long") for n in lens])).alias("window_len"))
    w = w.withColumn("window_start", start).withColumn("_end", F.least(F.col("window_start") + F.col("window_len"), F.col("_last")))
    d = metrics.join(w, "incident_id")
    return d.where((F.col("t") >= F.col("window_start")) & (F.col("t") < F.col("_end"))).drop("_last", "_end")


def parse_datetime_parts(df: DataFrame, parts: tuple[str, ...] = ("date_y", "date_m", "date_d", "time_h", "time_m", "time_s")) -> DataFrame:
    return df.withColumn("ts", F.make_timestamp_ntz(*[F.col(p) for p in parts]))


def pick_date(df: DataFrame, day: int, ts: str = "ts") -> DataFrame:
    return df.where(F.dayofmonth(ts) == day)


def split_trips(df: DataFrame, gap: float, key: str = "trip_key", x: str = "x") -> DataFrame:
    """``trip`` counts up where the gap to the previous row (seconds in ``x``) exceeds ``gap``; full seconds, no day wrap."""
    w = Window.partitionBy(key).orderBy(x)
    d = df.withColumn("gap", F.col(x) - F.lag(x).over(w))
    return d.withColumn("trip", F.sum(F.when(F.col("gap") > gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def pick_trip(trips: DataFrame, k: int, min_len: int = 20, key: str = "trip_key") -> DataFrame:
    """Rows of trip k of each key; trips of fewer rows than ``min_len`` yield nothing."""
    n = F.count("*").over(Window.partitionBy(key, "trip"))
    return trips.withColumn("_n", n).where((F.col("trip") == k) & (F.col("_n") >= min_len)).drop("_n")


def resample_linear(trips: DataFrame, step: int, digits: int = 5, key: str = "trip_key", x: str = "x", value: str = "value") -> DataFrame:
    """A regular grid from each trip's first sample, linear between neighbours; samples on the grid are copied."""
    one = trips.groupBy(key, "trip", F.col(x).alias("x")).agg(F.max(value).alias("v"))
    grid = one.groupBy(key, "trip").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    grid = grid.select(key, "trip", F.explode(F.sequence("lo", "hi", F.lit(step).cast("long"))).alias("x"))
    both = one.withColumn("g", F.lit(False)).unionByName(grid.withColumn("v", F.lit(None).cast("double")).withColumn("g", F.lit(True)))
    per = both.groupBy(key, "trip", "x").agg(F.max("v").alias("v"), F.max("g").alias("g"))
    w = Window.partitionBy(key, "trip").orderBy("x")
    back = Window.partitionBy(key, "trip").orderBy(F.desc("x"))
    s = F.last(F.when(F.col("v").isNotNull(), F.struct("x", "v")), True)
    per = per.withColumn("_p", s.over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", s.over(back.rowsBetween(Window.unboundedPreceding, 0)))
    mid = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col("x") - F.col("_p.x")) / F.when(F.col("_n.x") != F.col("_p.x"), F.col("_n.x") - F.col("_p.x"))
    return per.where("g").select(key, "trip", "x", F.round(F.coalesce("v", mid), digits).alias("value"))


def clean_names(name: Column, replacements: list[tuple[str, str]]) -> Column:
    """Literal replacements in order; an empty replacement deletes."""
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), replacements, name)


def classify(name: Column, rules: list[tuple[str, str]], other: str = "others") -> Column:
    """The class of the first keyword that the name contains."""
    out = F.lit(other)
    for word, kind in reversed(rules):
        out = F.when(F.contains(name, F.lit(word)), kind).otherwise(out)
    return out


def lag_matrix(pairs: DataFrame, lag: int) -> DataFrame:
    """Rows (incident_id, x, y, t, y0, y1.., x1..) of lagged samples; the first ``lag`` rows and series of 3 * lag + 1 rows or fewer go.

    ``pairs`` has incident_id, x, y, t, vx and vy.
    """
    key = Window.partitionBy("incident_id", "x", "y")
    w = key.orderBy("t")
    cols = [F.lag("vy", k).over(w).alias(f"y{k}") for k in range(1, lag + 1)] + [F.lag("vx", k).over(w).alias(f"x{k}") for k in range(1, lag + 1)]
    d = pairs.select("incident_id", "x", "y", "t", F.col("vy").alias("y0"), *cols, F.row_number().over(w).alias("_i"), F.count("*").over(key).alias("_n"))
    return d.where((F.col("_i") > lag) & (F.col("_n") > 3 * lag + 1)).drop("_i", "_n")


def segment_splits(lengths: DataFrame, step: int) -> DataFrame:
    """Boundaries 0, step, .. of int(n / step) segments per incident; the last segment takes the remainder."""
    k = F.floor(F.col("n") / step).cast("long")
    seg = F.explode(F.sequence(F.lit(0).cast("long"), k))
    return lengths.where(k > 0).select("incident_id", "n", k.alias("_k"), seg.alias("seg")).select("incident_id", F.col("seg").cast("int").alias("seg"), F.when(F.col("seg") == F.col("_k"), F.col("n")).otherwise(F.col("seg") * step).cast("long").alias("pos"))


def candidate_intervals(segments: DataFrame, min_len: int, max_len: int) -> DataFrame:
    a = segments.select("incident_id", F.col("seg").alias("seg_i"), F.col("pos").alias("start"))
    b = segments.select("incident_id", F.col("seg").alias("seg_j"), F.col("pos").alias("end"))
    size = F.col("end") - F.col("start")
    return a.join(b, "incident_id").where((F.col("seg_i") < F.col("seg_j")) & (size >= min_len) & (size <= max_len))


def slice_history_current(metrics: DataFrame, hist: tuple, cur: tuple) -> DataFrame:
    """``part`` is history or current by two slices; negative bounds count from the end, None is open."""
    size = F.max("t").over(Window.partitionBy("incident_id")) + 1
    d = metrics.withColumn("_T", size)

    def inside(lo, hi):
        at = lambda x: F.col("_T") + x if x < 0 else F.lit(x)
        c = F.lit(True)
        if lo is not None:
            c = c & (F.col("t") >= at(lo))
        if hi is not None:
            c = c & (F.col("t") < at(hi))
        return c

    a, b = d.where(inside(*hist)).withColumn("part", F.lit("history")), d.where(inside(*cur)).withColumn("part", F.lit("current"))
    return a.unionByName(b).drop("_T")
