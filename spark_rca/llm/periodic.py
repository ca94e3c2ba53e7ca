"""Periodic runs of words: tiles per period octave, boundary Z-values, fragments stitched by document and period.

Periods from u to 2u - 1 (u a power of two) are an octave.  For each, a text is exploded into tiles of 12 u words, one
every 4 u words, so that neighbours share 8 u words, what a run of the least length has at most.  A tile is
solved alone: boundaries lie u words apart, and a run of at least four periods holds the three periods after one of
them.  The Z-value of a boundary for a period is how far the words from it equal those a period later; extended to
both sides inside the tile it bounds a fragment, which counts at the first boundary after its start only.
A period whose words are a power of a shorter word is left to that one.  Fragments of at least the least length
go by document and period to a window that stitches those that overlap by a period: a run is whole in one
tile or has such a fragment in every tile on its way.

Only fragments are shuffled, and the texts that have any; all others are finished where they are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from spark_rca.llm.bytehash import batches, prefix, span, summed, words
from spark_rca.llm.common import free_names, lean, materialize, row_key
from spark_rca.llm.mixing import WORD

#: Least exponent and length of a run; words of a tile and between tiles, and pairs compared at once.
EXPONENT, LEAST = 4, 6
TILE, STEP, PAIRS = 12, 4, 1 << 20

_FACTOR: list[np.ndarray] = [np.arange(2)]


def smallest_factors(n: int) -> np.ndarray:
    """The smallest prime factor of every number up to n."""
    if len(_FACTOR[0]) <= n:
        out = np.arange(2 * n)
        for p in range(2, int((2 * n) ** 0.5) + 1):
            if out[p] == p:
                rest = out[p * p :: p]
                rest[rest == np.arange(p * p, 2 * n, p)] = p
        _FACTOR[0] = out
    return _FACTOR[0]


def reach(p: np.ndarray, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words from ``a`` on equal those from ``b`` on (``back``: before them), at least ``low`` and at most ``high``.

    ``p`` are prefix hashes of the words; the answer is bisected.
    """
    low, high = low.copy(), high.copy()
    while len(i := np.flatnonzero(low < high)):
        mid = (low[i] + high[i] + 1) // 2
        x, y = a[i], b[i]
        same = span(p, x - mid, x) == span(p, y - mid, y) if back else span(p, x, x + mid) == span(p, y, y + mid)
        low[i[same]], high[i[~same]] = mid[same], mid[~same] - 1
    return low


def tiles(offs: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the tiles of one octave begin and end; ``offs`` bounds the texts' words."""
    n = np.diff(offs)
    long = np.flatnonzero(n >= max(LEAST, EXPONENT * unit))
    count = np.maximum(-(-(n[long] - TILE * unit) // (STEP * unit)), 0) + 1
    text = np.repeat(long, count)
    lo = offs[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STEP * unit
    return lo, np.minimum(lo + TILE * unit, offs[text + 1])


def solve_tiles(w: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, start, end) of the fragments of an octave's tiles; ``w`` are word hashes, ``p`` their prefix hashes."""
    count = np.maximum((hi - lo - 3 * unit) // unit + 1, 0)
    tile = np.repeat(np.arange(len(lo)), count)
    m = lo[tile] + (np.arange(len(tile)) - np.repeat(np.cumsum(count) - count, count)) * unit
    octave = np.arange(unit, 2 * unit)
    found = []
    for x in range(0, len(m), max(1, PAIRS // unit)):
        i = np.arange(x, min(len(m), x + max(1, PAIRS // unit)))
        row, q = np.nonzero(w[m[i][:, None] + octave] == w[m[i]][:, None])
        i, q = i[row], q + unit
        for test in (lambda a, q, t: w[a + 1] == w[a + q + 1], lambda a, q, t: a + 3 * q <= hi[t], lambda a, q, t: span(p, a, a + 2 * q) == span(p, a + q, a + 3 * q)):
            fine = test(m[i], q, tile[i])
            i, q = i[fine], q[fine]
        # Is the period a power of a shorter word?
        rest, factor = q.copy(), smallest_factors(2 * unit)
        while (rest > 1).any():
            f = factor[rest]
            d = np.where(rest > 1, q // np.maximum(f, 1), 0)
            a = m[i]
            fine = (d == 0) | (span(p, a, a + q - d) != span(p, a + d, a + q))
            rest = rest // np.maximum(f, 1)
            i, q, rest = i[fine], q[fine], rest[fine]
        a, t = m[i], tile[i]
        inner = a > lo[t]
        first = ~inner
        first[inner] = span(p, a[inner] - unit, a[inner]) != span(p, a[inner] + q[inner] - unit, a[inner] + q[inner])
        a, q, t, inner = a[first], q[first], t[first], inner[first]
        before = reach(p, a, a + q, np.zeros_like(q), np.where(inner, unit - 1, 0), back=True)
        after = reach(p, a, a + q, 2 * q, hi[t] - a - q)
        s, e = a - before, a + q + after
        fine = e - s >= np.maximum(LEAST, EXPONENT * q)
        found.append((q[fine], s[fine], e[fine]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip((none, none, none), *found, strict=True))


def fragments(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, period, start, end) of the fragments of all octaves, by text, and each text's number of words."""
    begins, ends, at = words(data, offs)
    w = span(prefix(data), begins, ends)
    p = summed(w)
    out, unit, longest = [], 1, int(np.diff(at).max(initial=0))
    while EXPONENT * unit <= longest:
        out.append(solve_tiles(w, p, *tiles(at, unit), unit))
        unit *= 2
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.diff(at)
    q, s, e = (np.concatenate(c) for c in zip(*out, strict=True))
    text = np.searchsorted(at, s, "right") - 1
    order = np.argsort(text, kind="stable")
    text = text[order]
    return text, q[order], s[order] - at[text], e[order] - at[text], np.diff(at)


FRAGMENTS = "array<struct<period:long,lo:long,hi:long>>"
RUN = "struct<start:long,length:long,period:long>"
#: What ``collapse_runs`` adds.
ADDED = {"n_words": "long", "n_dropped": "long", "n_runs": "long", "runs": f"array<{RUN}>", "collapsed": "string"}


def _struct_list(counts: np.ndarray, cols: dict[str, np.ndarray]) -> pa.Array:
    offs = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return pa.ListArray.from_arrays(offs, pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols.values()], list(cols)))


def _shown(kept: bytes, digest: bool) -> str:
    return hashlib.sha256(kept).hexdigest() if digest else kept.decode()


def stitch(frags: DataFrame, keys: list[str]) -> DataFrame:
    """Runs (keys, start, length, period) from fragments (keys, period, lo, hi), also if these repeat.

    Two runs of one period share less than a period of words, fragments of one run at least that.
    """
    new, run = free_names(frags, "new", "run")
    order = Window.partitionBy(*keys, "period").orderBy("lo", "hi")
    apart = F.coalesce(F.col("lo") > F.lag("hi").over(order) - F.col("period"), F.lit(True))
    marked = frags.withColumn(new, apart.cast("int"))
    marked = marked.withColumn(run, F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = marked.groupBy(*keys, "period", run).agg(F.min("lo").alias("start"), F.max("hi").alias("_hi"))
    return whole.select(*keys, "start", (F.col("_hi") - F.col("start")).alias("length"), "period")


def collapse_runs(docs: DataFrame, digest: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, ...), without the text, with its runs and the text that they collapse to.

    Added are ``n_words``, ``n_dropped`` (words that some run holds after its first period), ``n_runs``, ``runs`` (start, length and
    period, by start, then period) and ``collapsed``: the words that stay, joined by a blank, or with
    ``digest`` the lowercase hex SHA-256 of that, which spares writing texts that have no run.

    Null and empty texts have no words, no runs and an empty ``collapsed``; rows repeated, without an id too,
    get the same; an empty table gives an empty one.  Other columns stay as they are; those of the added
    names are replaced.  Words are compared by 64-bit hashes.
    """
    cols = [c for c in docs.columns if c.lower() not in ADDED and c != "text"]
    k1, k2, frags_, text_ = keys = free_names(docs, "key", "check", "frags", "text")
    keys = keys[:2]
    keyed = docs.select(*cols, F.col("text").alias(text_), row_key().alias(k1), F.hash("doc_id", "text").alias(k2))
    own = StructType([*docs.select(cols).schema.fields])
    schema = StructType([*own.fields]).add(k1, "long").add(k2, "integer").add(text_, "string").add(frags_, DataType.fromDDL(FRAGMENTS)).add("n_words", "long").add("collapsed", "string")

    def solve(it):
        for b in it:
            t = pa.Table.from_batches([b])
            for row, data, offs in batches(t[text_]):
                text, q, s, e, n = fragments(data, offs)
                counts = np.bincount(text, minlength=len(n))
                part = t.slice(row, len(n))
                raw, at = data.tobytes(), offs.tolist()
                done = [None if c else _shown(b" ".join(raw[x:y].split()), digest) for c, x, y in zip(counts.tolist(), at[:-1], at[1:], strict=True)]
                carried = [x if c else None for c, x in zip(counts.tolist(), part[text_].to_pylist(), strict=True)]
                part = part.select([*cols, *keys]).append_column(text_, pa.array(carried, pa.string()))
                part = part.append_column(frags_, _struct_list(counts, {"period": q, "lo": s, "hi": e}))
                yield from part.append_column("n_words", pa.array(n, pa.int64())).append_column("collapsed", pa.array(done, pa.string())).to_batches()

    solved = materialize(keyed.mapInArrow(lean(solve), schema))
    none = F.size(frags_) == 0
    pieces = solved.where(~none).select(*keys, F.explode(frags_).alias("f")).select(*keys, "f.*")
    runs = stitch(pieces, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    result = StructType([*own.fields])
    for name, kind in ADDED.items():
        result = result.add(name, DataType.fromDDL(kind))

    def collapse(it):
        for b in it:
            t = pa.Table.from_batches([b])
            gone, kept = [], []
            for text, runs in zip(t[text_].to_pylist(), t["runs"].to_pylist(), strict=True):
                w = text.encode().split()
                delta = np.zeros(len(w) + 1, np.int64)
                for r in runs:
                    delta[r["start"] + r["period"]] += 1
                    delta[r["start"] + r["length"]] -= 1
                stay = np.flatnonzero(np.cumsum(delta[:-1]) == 0)
                gone.append(len(w) - len(stay))
                kept.append(_shown(b" ".join([w[i] for i in stay.tolist()]), digest))
            out = t.select([*cols, "n_words"]).append_column("n_dropped", pa.array(gone, pa.int64()))
            out = out.append_column("n_runs", pa.array([len(r) for r in t["runs"].to_pylist()], pa.int64()))
            yield from out.append_column("runs", t["runs"]).append_column("collapsed", pa.array(kept, pa.string())).to_batches()

    open_ = solved.where(~none).select(*cols, *keys, text_, "n_words").join(runs, keys).select(*cols, "n_words", text_, "runs")
    zero = F.lit(0).cast("long")
    done = solved.where(none).select(*cols, "n_words", zero.alias("n_dropped"), zero.alias("n_runs"), F.array().cast(f"array<{RUN}>").alias("runs"), "collapsed")
    return done.unionByName(open_.mapInArrow(lean(collapse), result))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the contract's edit: a tenth of the texts, by checksum of doc_id, become periodic from some word on.

    Null ids and texts and texts without a word stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    hash_, words_, size_, from_, per = free_names(docs, "hash", "words", "size", "from", "per")
    d = docs.withColumn(hash_, h).withColumn(words_, F.when(F.col(hash_) % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    g, w, n = F.floor(F.col(hash_) / 10), F.col(words_), F.col(size_)
    d = d.withColumn(size_, F.when(F.size(w) > 0, F.size(w)).cast("long"))
    d = d.withColumn(from_, (g % n).cast("int")).withColumn(per, (1 + F.floor((n - F.col(from_)) / (3 + g % 8))).cast("int"))
    period = F.slice(w, F.col(from_) + 1, F.col(per))
    again = F.flatten(F.array_repeat(period, F.ceil((n - F.col(from_)) / F.col(per)).cast("int")))
    text = F.array_join(F.concat(F.slice(w, F.lit(1), F.col(from_)), F.slice(again, F.lit(1), (n - F.col(from_)).cast("int"))), " ")
    return d.withColumn("text", F.when(n.isNotNull(), text).otherwise(F.col("text"))).select(docs.columns)


def best_run(runs: Column) -> Column:
    """The run of greatest length / period; of equal ones that of smallest start, then period.  Null without a run.

    Quotients of different runs differ as doubles as long as a text has fewer than 10^8 words.
    """
    keyed = F.transform(runs, lambda r: F.struct((-r["length"] / r["period"]).alias("e"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(keyed)


def periodic_query(docs: DataFrame) -> DataFrame:
    """The contract's columns, then n_words and n_dropped."""
    out = collapse_runs(with_planted_periods(docs.select("doc_id", "text")), digest=True).withColumn("_best", best_run(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.col("n_runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    milli = F.floor(F.col("_best.length") * 1000 / F.col("_best.period"))
    return out.select("doc_id", "n_runs", F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"), milli.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"), "n_words", "n_dropped")
