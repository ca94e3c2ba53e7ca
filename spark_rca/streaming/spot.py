"""Streaming peaks over threshold: adaptive alarm levels for univariate series.

One step function serves batch (a group per series) and stream (keyed state), so both give the same
rows for any split of the data.  Variants: one- or two-sided, with or without drift removal, and
``adapt``, where points over the alarm level are learned as peaks instead of raising an alarm.
All peaks are kept unless ``max_peaks`` bounds the state of a stream.
The method is that of the published streaming extreme-value algorithm (KDD 2017).
"""

from __future__ import annotations

import json
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from spark_rca.functions.numeric import gpd_fit, tail_level
from spark_rca.operators.lineage import cut

OUT = "incident_id string, service_id int, t long, value double, upper double, lower double, alarm boolean"


class Spot:
    """State of one series: thresholds, peaks and levels per side, and the last normal values."""

    def __init__(self, q: float = 1e-4, level: float = 0.98, depth: int = 0, two_sided: bool = False, adapt: bool = False, max_peaks: int | None = None):
        self.q, self.level, self.depth, self.adapt, self.max_peaks = q, level, depth, adapt, max_peaks
        self.sides = [1, -1] if two_sided else [1]
        self.n, self.last_t, self.ring = 0, None, []
        self.thr: dict[str, float] = {}
        self.z: dict[str, float] = {}
        self.peaks: dict[str, list[float]] = {}
        self.count: dict[str, int] = {}

    def fit(self, init: np.ndarray) -> None:
        """Calibrate on the first samples: thresholds are order statistics at index int(level * n)."""
        v = np.asarray(init, float)
        if self.depth:
            d = min(self.depth, max(len(v) - 1, 1))
            means = np.convolve(v, np.ones(d) / d, "valid")
            self.ring = v[-d:].tolist()
            v = v[d:] - means[:-1] if len(v) > d else v - v.mean()
        self.n = len(v)
        order = np.sort(v)
        for s in self.sides:
            k = str(s)
            share = self.level if s > 0 else 1 - self.level
            self.thr[k] = float(order[min(int(share * len(order)), len(order) - 1)]) if len(order) else 0.0
            self.peaks[k] = [float(x) for x in s * (v - self.thr[k]) if x > 0]
            self.count[k] = len(self.peaks[k])
            self._refit(s)

    def _refit(self, s: int) -> None:
        k = str(s)
        g, sigma = gpd_fit(np.array(self.peaks[k]))
        self.z[k] = tail_level(self.q, max(self.n, 1), max(self.count[k], 1), self.thr[k], g, sigma, s)

    def step(self, value: float) -> tuple[float, float | None, bool]:
        """(upper, lower, alarm) after one value."""
        base = float(np.mean(self.ring)) if self.ring else 0.0
        x, alarm, peak = value - base, False, False
        for s in self.sides:
            k = str(s)
            over = s * (x - self.z[k]) > 0
            if over and not self.adapt:
                alarm = True
                break
            if over or s * (x - self.thr[k]) > 0:
                self.peaks[k].append(s * (x - self.thr[k]))
                self.count[k] += 1
                # A bound, if asked for, keeps the largest excesses and biases the tail.
                if self.max_peaks is not None and len(self.peaks[k]) > self.max_peaks:
                    self.peaks[k].remove(min(self.peaks[k]))
                self.n += 1
                self._refit(s)
                peak = True
                break
        if not alarm and not peak:
            self.n += 1
        if not alarm and self.depth:
            self.ring = [*self.ring[1:], value] if len(self.ring) >= self.depth else [*self.ring, value]
        lower = self.z.get("-1")
        return self.z["1"] + base, None if lower is None else lower + base, alarm

    def dump(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def load(cls, text: str) -> Spot:
        out = cls()
        out.__dict__.update(json.loads(text))
        return out

    def head(self) -> str:
        """Everything but the peaks, whose number grows."""
        return json.dumps({k: v for k, v in self.__dict__.items() if k != "peaks"})

    @classmethod
    def restore(cls, head: str, peaks: dict[str, list[float]]) -> Spot:
        out = cls.load(head)
        out.peaks = peaks
        return out


class Series:
    """A series as it comes: samples until it is calibrated, then its Spot.  Both the state table and the stream feed it."""

    def __init__(self, n_init: int, options: dict, spot: Spot | None = None, buffer: list[tuple[int, float]] | None = None):
        self.n_init, self.options, self.spot, self.buffer = n_init, options, spot, buffer or []
        self.last = spot.last_t if spot else self.buffer[-1][0] if self.buffer else None

    def feed(self, samples: list[tuple[int, float]]) -> list[tuple]:
        """(t, value, upper, lower, alarm) of new samples, by t.  Those at or before the last t are late, and of those with one t the least value counts."""
        out = []
        for t, v in sorted(samples):
            if self.last is not None and t <= self.last:
                continue
            self.last = t
            if self.spot is None:
                self.buffer.append((t, v))
                if len(self.buffer) == self.n_init:
                    self.spot = Spot(**self.options)
                    self.spot.fit(np.array([x for _, x in self.buffer]))
                    self.buffer = []
            else:
                out.append((t, v, *self.spot.step(v)))
            if self.spot is not None:
                self.spot.last_t = t
        return out


def _samples(pdf: pd.DataFrame) -> list[tuple[int, float]]:
    d = pdf[["t", "value"]].dropna()
    return list(zip(d["t"].astype("int64").tolist(), d["value"].astype(float).tolist(), strict=True))


def run_spot(metrics: DataFrame, n_init: int | None = None, **options) -> DataFrame:
    """Thresholds and alarms of every series in batch; ``n_init`` samples (half by default) calibrate and give no row.

    Samples without t or value are left out; of those with one t the least value counts.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["t", "value"]).sort_values(["t", "value"]).drop_duplicates("t")
        k = len(pdf) // 2 if n_init is None else n_init
        spot = Spot(**options)
        spot.fit(pdf["value"].to_numpy()[:k])
        rows = [(r.incident_id, r.service_id, r.t, r.value, *spot.step(r.value)) for r in pdf.iloc[k:].itertuples(index=False)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    return metrics.select("incident_id", "service_id", "t", "value").groupBy("incident_id", "service_id").applyInPandas(run, OUT)


def fit_tails(metrics: DataFrame, level: float = 0.98) -> DataFrame:
    """(incident_id, service_id, peaks, gamma, sigma): the tail of each series over its ``level`` quantile."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf["value"].to_numpy(float)
        t = np.quantile(v, level)
        gamma, sigma = gpd_fit(v[v > t] - t)
        return pd.DataFrame({"incident_id": pdf["incident_id"].iloc[:1], "service_id": pdf["service_id"].iloc[:1], "peaks": [int((v > t).sum())], "gamma": [gamma], "sigma": [sigma]})

    return metrics.select("incident_id", "service_id", "value").groupBy("incident_id", "service_id").applyInPandas(run, "incident_id string, service_id int, peaks long, gamma double, sigma double")


#: A series' state between appends: ``head`` is null until ``n_init`` samples have come, which wait in ``buffer``.
STATE = "incident_id string, service_id int, head string, upper_peaks array<double>, lower_peaks array<double>, buffer array<struct<t:long,value:double>>"
_BOTH = f"{OUT}, head string, upper_peaks array<double>, lower_peaks array<double>, buffer array<struct<t:long,value:double>>, is_state boolean"
_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def append_spot(state: DataFrame, new: DataFrame, n_init: int, **options) -> tuple[DataFrame, DataFrame]:
    """(rows, next state) after ``new`` samples (incident_id, service_id, t, value) of any series.

    ``state`` (STATE) is what the last append gave, or empty; series without new samples keep theirs.  Whatever the
    appends, the rows are those of one batch run with the same ``n_init`` over all samples, as long as each append's samples come after
    those of the last; later ones are left out, repeated ones too.  State and samples meet in one join by
    series and are written once, rows and state together.
    """

    def run(key, old, pdf):
        if len(old):
            r = old.iloc[0]
            peaks = {"1": list(r["upper_peaks"])} | ({"-1": list(r["lower_peaks"])} if r["lower_peaks"] is not None else {}) if r["head"] is not None else {}
            s = Series(n_init, options, Spot.restore(r["head"], peaks) if r["head"] is not None else None, [(int(x["t"]), float(x["value"])) for x in r["buffer"]])
        else:
            s = Series(n_init, options)
        rows = [(*key, *x, None, None, None, None, False) for x in s.feed(_samples(pdf))]
        blank = [None] * (len(_COLUMNS) - 2)
        spot = s.spot
        kept = [spot.head(), spot.peaks["1"], spot.peaks.get("-1")] if spot else [None, None, None]
        rows.append((*key, *blank, *kept, [{"t": t, "value": v} for t, v in s.buffer], True))
        return pd.DataFrame(rows, columns=[*_COLUMNS, "head", "upper_peaks", "lower_peaks", "buffer", "is_state"]).astype({"t": "Int64", "alarm": "boolean"})

    keys = ["incident_id", "service_id"]
    old = state.select([F.col(c.split()[0]).alias(c.split()[0]) for c in STATE.split(", ")])
    both = cut(old.groupBy(*keys).cogroup(new.select("incident_id", "service_id", "t", "value").groupBy(*keys)).applyInPandas(run, _BOTH))
    return both.where("NOT is_state").select(*_COLUMNS), both.where("is_state").select([c.split()[0] for c in STATE.split(", ")])


def append_batch(spark: SparkSession, store: str, number: int, new: DataFrame, n_init: int, **options) -> DataFrame:
    """The rows of append ``number`` (from 0), with the state of the one before read from ``store`` and the next one left there.

    Both are written in place of what an earlier try of the same number has left, so a try that failed, or a micro-batch that
    ``foreachBatch`` repeats, changes nothing.
    """
    at = lambda kind, n: f"{store}/{kind}/number={n}"
    state = spark.read.schema(STATE).parquet(at("state", number - 1)) if number else spark.createDataFrame([], STATE)
    rows, state = append_spot(state, new, n_init, **options)
    rows.write.mode("overwrite").parquet(at("rows", number))
    state.write.mode("overwrite").parquet(at("state", number))
    return spark.read.schema(OUT).parquet(at("rows", number))


class SpotProcessor(StatefulProcessor):
    """Keyed state of a streamed series: a value of fixed size, and a list of peaks per side to which new ones are appended."""

    def __init__(self, n_init: int, options: dict):
        self.n_init, self.options = n_init, options

    def init(self, handle) -> None:
        self.head = handle.getValueState("head", "head string")
        self.buffer = handle.getListState("buffer", "t long, value double")
        self.peaks = {"1": handle.getListState("upper", "x double"), "-1": handle.getListState("lower", "x double")}

    def handleInputRows(self, key, rows, timerValues):
        samples = [x for pdf in rows for x in _samples(pdf)]
        known = self.head.exists()
        peaks = {k: [x[0] for x in s.get()] for k, s in self.peaks.items()} if known else {}
        spot = Spot.restore(self.head.get()[0], {k: v for k, v in peaks.items() if k == "1" or v or self.options.get("two_sided")}) if known else None
        s = Series(self.n_init, self.options, spot, [] if known else [tuple(x) for x in self.buffer.get()])
        waiting = len(s.buffer)
        out = s.feed(samples)
        if s.spot is not None:
            if not known:
                self.buffer.clear()
            self.head.update((s.spot.head(),))
            for k, now in s.spot.peaks.items():
                if s.spot.max_peaks is not None:  # a bound drops some of the old ones
                    self.peaks[k].put([(x,) for x in now]) if now else self.peaks[k].clear()
                elif fresh := now[len(peaks.get(k, [])) :]:
                    self.peaks[k].appendList([(x,) for x in fresh])
        elif fresh := s.buffer[waiting:]:
            self.buffer.appendList(fresh)
        yield pd.DataFrame([(*key, *x) for x in out], columns=_COLUMNS)

    def close(self) -> None:
        pass


#: The state store that lists need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_spot(stream: DataFrame, n_init: int, **options) -> DataFrame:
    """The same over a streaming DataFrame (incident_id, service_id, t, value), append mode.

    Each micro-batch is sorted by t; rows at or before the last processed t are late and dropped.  A micro-batch writes the
    series' fixed part and its new peaks only.  The session's state store becomes RocksDB, which alone has lists.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    d = stream.select("incident_id", F.col("service_id").cast("int").alias("service_id"), F.col("t").cast("long").alias("t"), F.col("value").cast("double").alias("value"))
    return d.groupBy("incident_id", "service_id").transformWithStateInPandas(SpotProcessor(n_init, options), OUT, "append", "none")


def stream_prepare(events: DataFrame, bucket: str, delay: str, incident, service) -> DataFrame:
    """Tumbling sums per service in event time; rows later than the watermark are dropped.

    Works on a stream or a batch table with columns ts and value.
    """
    e = events.withWatermark("ts", delay) if events.isStreaming else events
    g = e.groupBy(F.window("ts", bucket).alias("w"), incident.alias("incident_id"), service.alias("service_id")).agg(F.sum("value").alias("value"))
    return g.select("incident_id", "service_id", F.col("w.start").alias("start"), "value")


def stream_trips(events: DataFrame, gap: str, delay: str, key: str) -> DataFrame:
    """Trips as session windows: a gap of at least ``gap`` closes one."""
    e = events.withWatermark("ts", delay) if events.isStreaming else events
    g = e.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("start"), "n")
