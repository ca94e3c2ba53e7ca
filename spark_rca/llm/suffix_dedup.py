"""Suffix-array dedup: bytes that a repeated string of ``length`` bytes covers go.

1. Anchors deal the work.  Every window of ``length`` bytes has a minimizer (its k-gram of least hash), so
   equal windows have equal minimizers at equal places.  A document is cut into runs of windows with one
   minimizer, its anchor; a run's bytes are a fragment.  Only hashes are shuffled: an anchor that
   occurs once has no repeated window, nor has a fragment that shares neither half of what surrounds it.
2. Expansion finds the repeats.  One copy of each other fragment is fetched, with its number of occurrences,
   and dealt by anchor.  A task concatenates fragments, builds their Burrows-Wheeler transform and
   extends intervals backward, breadth first: what an interval of strings of n + 1 bytes ends with first
   has a common prefix of n bytes, so the common prefixes of neighbouring suffixes come by increasing
   value.  It stops at ``length``: suffixes that then have no value share more with a neighbour and are,
   with those of fragments that occur twice, exactly the starts of repeated windows.
3. An anchor with more bytes than a task takes is split: its windows, by their distance from the
   anchor, into halves that share a longer core, so the core's hash divides the group; equal
   pieces are settled at once.  A hot passage dissolves in a few rounds.

Repeats may be counted in words as well: each word becomes a code, ``CODE`` bytes of its hash, and the same steps
find the strings of that many codes, whatever bytes or white space the words take.  A code is one symbol there:
lengths, places and steps count words, only fragments that move have ``CODE`` bytes for each.

Strings are judged on the input, and matches never cross documents.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spark_rca.llm.bytehash import batches, grams, prefix, span, summed
from spark_rca.llm.bytehash import words as word_bounds
from spark_rca.llm.common import free_names, lean, materialize, materialize_alone, row_key, small_side

#: Bytes of the k-gram that is an anchor (for windows of 400 bytes), bytes that a task transforms at
#: once, bytes of one anchor's fragments that go to one task, and bytes that a task is dealt.
GRAM, BLOCK, HOT, DEALT = 64, 1 << 19, 1 << 20, 2 << 20

#: Bytes of a word's hash that stand for it where repeats are counted in words, and words of an anchor there.
CODE, GRAM_WORDS = 6, 8

def anchors(data: np.ndarray, offs: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor place, anchor, fragment, left and right hash) of every run of windows.

    ``data`` has bytes or codes of words.  The left hash is 0 or of what all windows share that start well
    before the anchor, the right hash of what all others share; two fragments with a common window have
    one of them in common.
    """
    n, w = len(data), length - k + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return (none, none, none, none, *[none.astype(np.uint64)] * 4)
    p = prefix(data) if data.dtype == np.uint8 else summed(data)
    at = np.arange(n - k + 1)
    key = (grams(p, k) & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64)
    if n >= 1 << 24:  # a text too long for a place in the key: ranks stand in for hash and place
        order = np.lexsort((at, key & ~np.uint64(0xFFFFFF)))
        key = np.empty(len(at), np.uint64)
        key[order] = np.arange(len(at), dtype=np.uint64)
    windows, reach, least = n - length + 1, 1, key
    while 2 * reach <= w:  # least keys of twice as many grams
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[:windows], least[w - reach : w - reach + windows])
    place = order[least.astype(np.int64)] if n >= 1 << 24 else (least & np.uint64(0xFFFFFF)).astype(np.int64)
    s = np.flatnonzero(np.arange(length, n + 1) <= np.repeat(offs[1:], np.diff(offs))[:windows])
    if not len(s):
        return anchors(data[:0], np.zeros(1, np.int64), length, k)
    place = place[s]
    cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))  # another text has other places
    lo, hi = s[cut], s[np.concatenate([cut[1:] - 1, [len(s) - 1]])]
    place, text = place[cut], np.searchsorted(offs, lo, "right") - 1
    frag = span(p, lo, hi + length) + (place - lo).astype(np.uint64)
    half = (length - k) // 2
    left = np.where(place - lo > half, span(p, np.maximum(place - half - 1, 0), place + k), np.uint64(0))
    right = np.where(hi + half >= place, span(p, place, np.minimum(place + length - half, n)), np.uint64(0))
    return text, lo, hi - lo + 1, place, span(p, place, place + k), frag, left, right


def _anchor_table(docs: DataFrame, length: int, k: int, coded: bool = False) -> DataFrame:
    """(key, gram, frag, left, right, lo, n, a): runs of windows; lo and a (the anchor's place in the fragment) count bytes or words.

    ``coded``: of the words' codes, made in the same task, for a second Python function in a plan means
    twice as many workers.
    """

    def run(it):
        for b in it:
            keys, row = b.column("key").to_numpy(), 0
            for _, data, offs in batches(b.column("text")):
                data, offs = word_codes(data, offs) if coded else (data, offs)
                text, lo, n, place, *hashes = anchors(data, offs, length, k)
                cols = [keys[row + text], *[h.view(np.int64) for h in hashes], lo - offs[text], n, place - lo]
                row += len(offs) - 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 6 + [pa.int32()] * 2, strict=True)], ["key", "gram", "frag", "left", "right", "lo", "n", "a"])

    return docs.mapInArrow(lean(run), "key long, gram long, frag long, left long, right long, lo long, n int, a int")


def word_codes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all words, for each text the index of its first word)."""
    a, b, first = word_bounds(data, offs)
    return span(prefix(data), a, b) & np.uint64((1 << 8 * CODE) - 1), first


def _coded(docs: DataFrame) -> DataFrame:
    """``docs`` (raw, fs) with the words' codes, ``CODE`` bytes each, for raw."""

    def run(it):
        for b in it:
            for row, data, offs in batches(b.column("raw")):
                codes, first = word_codes(data, offs)
                codes = np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 8)[:, :CODE])
                texts = pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer((first * CODE).astype(np.int32)), pa.py_buffer(codes)])
                yield pa.RecordBatch.from_arrays([texts, b.column("fs").slice(row, len(offs) - 1)], ["raw", "fs"])

    return docs.mapInArrow(lean(run), docs.schema)


def suffix_order(s: np.ndarray, last: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, its inverse, where in it the first 64 // bits symbols change) of pieces, by prefix doubling.

    ``s`` has numbers of symbols, from 1 and below 2**bits, and 0 at ``last``, the end of each piece.  Ends are distinct and
    sort first, so no common prefix crosses one.  A key holds two ranks and its own place, so that plain sorting orders it.
    """
    n, depth = len(s), 64 // bits
    places = np.flatnonzero(s)
    key = np.zeros(n + depth, np.uint64)
    key[:n] = s
    for j in range(1, depth):
        key[:n] = (key[:n] << np.uint64(bits)) | np.append(s[j:], np.zeros(min(j, n), s.dtype))
    size = np.diff(last, prepend=-1)
    short = np.zeros(n, bool)
    for j in range(1, depth):  # what follows a piece's end is no symbol of it
        low = np.uint64(bits * (depth - j))
        at = last[size > j] - j
        key[at] = key[at] >> low << low
        short[at] = True
    key = key[places]
    order = np.argsort(key)
    key = key[order]
    order = places[order]
    near = np.flatnonzero(short[order])  # equal keys that reach over an end differ by their ends, which are in order of place
    order[near] = order[near][np.lexsort((order[near], key[near]))]
    sa = np.concatenate([last, order])
    head = np.ones(n, bool)
    head[len(last) + 1 :] = key[1:] != key[:-1]
    start = head.copy()
    head[len(last) + near] = True
    first = np.flatnonzero(head)
    of = np.repeat(first, np.diff(np.append(first, n)))
    rank = np.empty(n, np.int64)
    rank[sa] = of
    live = np.flatnonzero(~(head & np.append(head[1:], True)))
    at, of = sa[live], of[live]
    while len(live):  # none of these reaches over an end
        after = rank[at + depth]
        if n <= 1 << 21:
            key = np.sort(of << 42 | after << 21 | np.arange(len(live)))
            order, key = key & ((1 << 21) - 1), key >> 21
        else:
            key = of << 32 | after
            order = np.argsort(key)
            key = key[order]
        at = at[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        sa[live] = at
        of = np.repeat(live[new], np.diff(np.append(np.flatnonzero(new), len(live))))
        rank[at] = of
        more = ~(new & np.append(new[1:], True))
        live, at, of = live[more], at[more], of[more]
        depth *= 2
    return sa, rank, start


def repeated_starts(pieces: list[bytes], length: int, times: list[int] | None = None, unit: int = 1) -> np.ndarray:
    """Places, in the pieces joined by one symbol each, where a string of ``length`` symbols starts that also starts elsewhere.

    A symbol is a byte, or a code of ``unit`` bytes.  A piece that occurs several ``times`` repeats all of its
    strings; ``length`` is 1 or more.
    """
    size = np.array([len(x) // unit + 1 for x in pieces], np.int64)
    last = np.cumsum(size) - 1
    n = int(last[-1]) + 1 if len(size) else 0
    if unit == 1:
        data = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)
        used = np.bincount(data, minlength=256) > 0
        count = int(used.sum())
        s = np.cumsum(used).astype(np.uint16)[data]
    else:
        codes = np.zeros((n - len(size), 8), np.uint8)
        codes[:, :unit] = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, unit)
        values, number = np.unique(codes.view(np.uint64).ravel(), return_inverse=True)
        count = len(values)
        s = np.zeros(n, np.uint32)
        s[np.delete(np.arange(n), last)] = number + 1
    top, bits = count + 1, max(count.bit_length(), -(-64 // length))  # no more than ``length`` symbols are sorted first
    s[last] = 0
    sa, rank, start = suffix_order(s, last, bits)
    shown = 64 // bits
    left = np.repeat(last, size)[sa] - sa
    start[left < shown] = True
    start[1:] |= left[:-1] < shown
    # Burrows-Wheeler transform and its last-to-first mapping.
    before = np.where(sa > 0, sa - 1, n - 1)
    bwt, lf = s[before], rank[before]
    turn = np.concatenate([[False], bwt[1:] != bwt[:-1]])
    run, since = np.cumsum(turn), np.concatenate([[0], np.flatnonzero(turn), [n]])
    # known[i]: suffixes i - 1 and i have a common prefix of fewer bytes than the strings of this step.
    known = np.append(start, True)
    lo = np.flatnonzero(start)
    hi = np.append(lo[1:], n)
    for _ in range(shown, length):
        if not len(lo):
            break
        whole = run[lo] == run[hi - 1]
        one = whole & (bwt[lo] > 0)
        a, b = lf[lo[one]], lf[hi[one] - 1]
        if not whole.all():  # by runs of one symbol, of which such an interval has few
            low, high = lo[~whole], hi[~whole]
            size_ = run[high - 1] - run[low] + 1
            of = np.repeat(np.arange(len(size_)), size_)
            r = np.repeat(run[low] - (np.cumsum(size_) - size_), size_) + np.arange(len(of))
            i, j = np.maximum(since[r], low[of]), np.minimum(since[r + 1], high[of]) - 1
            key = of * top + bwt[i]
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            i, j = i[order[new]], j[order[np.append(new[1:], True)]]
            fine = bwt[i] > 0
            a, b = np.concatenate([a, lf[i[fine]]]), np.concatenate([b, lf[j[fine]]])
        # Only an interval that ends where no value is known yet has one of this step, and goes on.
        fresh = ~known[b + 1]
        lo, hi = a[fresh], b[fresh] + 1
        known[hi] = True
    more = np.append(~known[:n], False)
    found = more[:-1] | more[1:]
    if times is not None:
        found |= np.repeat(np.array(times) > 1, size)[sa]
    return np.sort(sa[found & (left >= length)])


def solved(held: list[pa.RecordBatch], length: int, unit: int) -> pa.RecordBatch:
    """(gram, frag, s, e) of a block: whole groups of rows (gram, frag, body, base, c)."""
    rows = pa.Table.from_batches(held)
    body = rows["body"].to_pylist()
    joined = repeated_starts(body, length, rows["c"].to_pylist(), unit)
    first = np.cumsum([0, *[len(x) // unit + 1 for x in body]])
    piece = np.searchsorted(first, joined, "right") - 1
    cut = np.concatenate([[True], (piece[1:] != piece[:-1]) | (np.diff(joined) > length)])[: len(joined)]
    lead, tail = joined[cut], joined[np.append(cut[1:], True)[: len(joined)]]
    piece = piece[cut]
    at = rows["base"].to_numpy()[piece] - first[piece]
    cols = [rows["gram"].to_numpy()[piece], rows["frag"].to_numpy()[piece], lead + at, tail + at + length]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["gram", "frag", "s", "e"])


def _expand(pieces: DataFrame, length: int, unit: int) -> DataFrame:
    """(gram, frag, s, e): repeated symbols of each fragment, from interval expansion over blocks of whole groups."""

    def run(it):
        held, size, g = [], 0, None
        for b in it:
            if not b.num_rows:
                continue
            group = b.column("g").to_numpy()
            heads = np.flatnonzero(np.append(not held or group[0] != g, group[1:] != group[:-1]))
            before = np.cumsum([0, *pc.binary_length(b.column("body")).to_pylist()])
            at, g = 0, group[-1]
            while len(heads := heads[size + before[heads] - before[at] > BLOCK]):
                held.append(b.slice(at, int(heads[0]) - at))
                yield solved(held, length, unit)
                held, size, at = [], 0, int(heads[0])
            held.append(b.slice(at))
            size += before[-1] - before[at]
        if held:
            yield solved(held, length, unit)

    tasks = max(1, -(-(pieces.select(F.sum(F.length("body"))).first()[0] or 0) // DEALT))
    dealt = pieces.select("g", "gram", "frag", "body", "base", "c").repartition(tasks, "g").sortWithinPartitions("g")
    return dealt.mapInArrow(lean(run), "gram long, frag long, s long, e long")


def _settle(frags: DataFrame, length: int, k: int, hot: int, unit: int) -> DataFrame:
    """(gram, frag, s, e): repeated symbols (of ``unit`` bytes) of fragments with gram, frag, c (occurrences), a (anchor's place) and body."""
    w = length - k + 1
    pieces = frags.select(F.col("gram").alias("g"), "gram", "frag", "c", "a", "body", F.lit(0).alias("d0"), F.lit(w - 1).alias("d1"))
    ready, found, size = [], [], (F.length("body") / unit).cast("int")
    part = lambda at, n: F.expr(f"substring(body, ({at}) * {unit} + 1, ({n}) * {unit})")
    while True:  # until the core is the whole window, where all pieces of a group are equal
        stats = pieces.groupBy("g").agg(F.sum("c").alias("_c"), F.sum(F.length("body")).alias("_b"))
        stats = small_side(materialize(stats.where("_c > 1")))
        p = pieces.join(stats, "g")
        lo, hi = F.greatest(F.lit(0), F.col("a") - F.col("d1")), F.least(size - length, F.col("a") - F.col("d0"))
        ready.append(p.where(F.col("_b") <= hot).select("g", "gram", "frag", part("greatest(0, a - d1)", f"least(int(length(body) / {unit}) - {length}, a - d0) - greatest(0, a - d1) + {length}").alias("body"), lo.cast("long").alias("base"), "c"))
        big = p.where(F.col("_b") > hot).drop("_c", "_b")
        if not big.take(1):
            break
        mid = F.floor((F.col("d0") + F.col("d1")) / 2).cast("int")
        halves = big.withColumn("_h", F.explode(F.array(F.struct(F.col("d0").alias("x"), mid.alias("y")), F.struct((mid + 1).alias("x"), F.col("d1").alias("y"))))).select("g", "gram", "frag", "c", "a", "body", F.col("_h.x").alias("d0"), F.col("_h.y").alias("d1"))
        halves = halves.withColumn("_lo", lo).withColumn("_hi", hi).where("d0 <= d1 AND _lo <= _hi")
        core = part("a - d0", f"{length} - (d1 - d0)")
        own = F.xxhash64(part("_lo", f"_hi - _lo + {length}"), F.col("_lo") - F.col("a"), F.col("_hi") - F.col("a"))
        halves = materialize(halves.withColumn("g", F.xxhash64("g", "d0", core)).withColumn("_own", own))
        same = halves.groupBy("g", "_own").agg(F.sum("c").alias("_c"), F.min(F.struct("gram", "frag")).alias("_r"))
        joined = halves.join(same, ["g", "_own"])
        found.append(joined.where("_c > 1").select("gram", "frag", F.col("_lo").cast("long").alias("s"), (F.col("_hi") + length).cast("long").alias("e")))
        pieces = materialize(joined.where((F.col("_r.gram") == F.col("gram")) & (F.col("_r.frag") == F.col("frag"))).select("g", "gram", "frag", F.col("_c").alias("c"), "a", "body", "d0", "d1"))
    out = ready[0]
    for x in ready[1:]:
        out = out.unionByName(x)
    out = _expand(materialize(out), length, unit)
    for x in found:
        out = out.unionByName(x)
    return out


def repeated_spans(docs: DataFrame, length: int = 400, hot: int = HOT, coded: bool = False) -> DataFrame:
    """(key, spans): ranges, possibly overlapping, of bytes or, if ``coded``, words that repeated strings of ``length`` of them cover in rows (key, text)."""
    k, unit = min(GRAM_WORDS if coded else GRAM, max(1, length // 2)), CODE if coded else 1
    runs = materialize(_anchor_table(docs, length, k, coded))
    grams = materialize(runs.groupBy("gram").agg(F.count("*").alias("_n")).where("_n > 1").select("gram"))
    runs = materialize(runs.join(small_side(grams), "gram"))
    # All values of a group's first row, as hash aggregation keeps them.
    some = [F.first(c).alias(c) for c in ("left", "right", "key", "lo", "n", "a")]
    frags = materialize(runs.groupBy("gram", "frag").agg(F.count("*").alias("c"), *some))
    sides = frags.select("gram", "frag", F.explode(F.array("left", "right")).alias("side")).where("side <> 0")
    sides = materialize(sides.groupBy("gram", "side").agg(F.min("frag").alias("x"), F.max("frag").alias("y")).where("x <> y").select("gram", "side"))
    sides = small_side(sides)
    hit = frags.where("c = 1").select("gram", "frag", F.explode(F.array("left", "right")).alias("side")).join(sides, ["gram", "side"]).select("gram", "frag").distinct()
    frags = materialize(frags.where("c > 1").unionByName(frags.join(hit, ["gram", "frag"], "left_semi")).drop("left", "right"))
    needed = frags.groupBy("key").agg(F.collect_list(F.struct("gram", "frag", "c", "lo", "n", "a")).alias("fs"))
    texts = docs.select("key", F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("raw"))
    at = texts.join(needed, "key").select("raw", "fs")
    at = (_coded(at) if coded else at).select("raw", F.explode("fs").alias("f"))
    bodies = materialize(at.select("f.gram", "f.frag", "f.c", "f.a", F.expr(f"substring(raw, int(f.lo) * {unit} + 1, (f.n + {length - 1}) * {unit})").alias("body")))
    if bodies.count() > frags.count():  # rows that repeat a document as a whole
        bodies = materialize(bodies.dropDuplicates(["gram", "frag"]))
    found = small_side(materialize(_settle(bodies, length, k, hot, unit)))
    spans = runs.join(found, ["gram", "frag"]).select("key", (F.col("lo") + F.col("s")).alias("s"), (F.col("lo") + F.col("e")).alias("e"))
    return spans.groupBy("key").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


#: What ``remove_repeats`` adds.
ADDED = ("_kept", "n_bytes", "n_removed", "n_spans")


def remove_repeats(docs: DataFrame, length: int = 400, hot: int = HOT, names: tuple[str | None, ...] = ADDED, words: int | None = None, take: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, ...) with columns called ``names``: the bytes that stay, how many there were, how
    many go and in how many runs, for a fifth name, what stays as text, null where nothing goes, and, for a
    sixth, how many words are in runs of ``words`` words that are found twice.  A column whose name is None is
    left out.  With ``words``, what such a run covers goes too, from its first word to its last, whatever
    bytes and white space it has; runs that follow each other are one.  Without ``take`` these words are
    counted only, and stay.

    Null texts count as empty and keep no byte; texts shorter than ``length`` stay whole; a repeated
    row repeats all its windows, with or without an id; an empty table gives an empty one.  In the text, a
    character that lost some of its bytes goes.  Other columns stay as they are; those called ``names`` are
    replaced.  Spans come back to their rows in one join by row key.
    """
    cols = [c for c in docs.columns if c not in names]
    docs = docs.select(cols)
    key, where, counted = free_names(docs, "key", "spans", "counted")
    keyed = docs.withColumn(key, row_key())
    texts = keyed.select(F.col(key).alias("key"), "text")
    spans = materialize_alone(docs.sparkSession, lambda: repeated_spans(texts, length, hot))
    spans = spans.select(F.col("key").alias(key), F.col("spans").alias(where))
    if words:
        more = materialize_alone(docs.sparkSession, lambda: repeated_spans(texts, words, hot, True))
        spans = spans.join(more.select(F.col("key").alias(key), F.col("spans").alias(counted)), key, "full")
    rows = keyed.join(spans, key, "left").drop(key)
    schema = StructType([*docs.schema.fields])
    for name, kind in zip(names, ("binary", "long", "long", "long", "string", "long"), strict=False):
        schema = schema.add(name, kind) if name else schema
    whole, text_too = names[0] is not None, len(names) > 4 and names[4] is not None

    def cut(it):
        for b in it:
            for row, data, offs in batches(b.column(b.schema.names.index("text"))):
                t = pa.Table.from_batches([b.slice(row, len(offs) - 1)])
                kept, size, gone, count, left, found = [], [], [], [], [], []
                in_words = t[counted].to_pylist() if words else [None] * len(t)
                starts, ends, first = word_bounds(data, offs) if take and any(in_words) else (None, None, offs)
                for x, y, spans, coded, at in zip(offs[:-1].tolist(), offs[1:].tolist(), t[where].to_pylist(), in_words, first.tolist(), strict=False):
                    both, passages = [(s["s"], s["e"]) for s in spans or []], merged([(s["s"], s["e"]) for s in coded or []])
                    if take:
                        both += [(int(starts[at + s]) - x, int(ends[at + e - 1]) - x) for s, e in passages]
                    runs = merged(both)
                    found.append(sum(e - s for s, e in passages))
                    size.append(y - x)
                    gone.append(sum(e - s for s, e in runs))
                    count.append(len(runs))
                    parts = []
                    if whole or runs:
                        parts = [data[x + s : x + e].tobytes() for s, e in zip([0, *[e for _, e in runs]], [*[s for s, _ in runs], y - x], strict=True)]
                    kept.append(b"".join(parts) if whole else None)
                    left.append("".join(p.decode("utf-8", "ignore") for p in parts) if text_too and runs else None)
                t = t.select(cols)
                for name, values, kind in zip(names, (kept, size, gone, count, left, found), (pa.binary(), *[pa.int64()] * 3, pa.string(), pa.int64()), strict=False):
                    t = t.append_column(name, pa.array(values, kind)) if name else t
                yield from t.to_batches()

    return rows.select(*cols, where, *[counted] * bool(words)).mapInArrow(lean(cut), schema)


def suffix_query(docs: DataFrame) -> DataFrame:
    """The contract's columns, whether anything goes, and how many words are in runs of over 50 words that are found twice.

    Such a passage may have fewer than 400 bytes, or other white space; the contract lets it stay, so it is told only.
    """
    out = remove_repeats(docs.select("doc_id", "text"), names=(*ADDED, None, "n_passage_words"), words=51, take=False)
    told = (F.col("n_removed") > 0).alias("has_repeats"), "n_passage_words", (F.col("n_passage_words") > 0).alias("has_passage")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("_kept", 256).alias("kept_sha256"), *told)


def drop_repeats(docs: DataFrame, length: int = 400, words: int | None = None) -> DataFrame:
    """Pipeline stage: texts without repeated bytes or, if asked for, ``words``; a character that a cut parts goes as a whole.

    n_chars follows the text.  A document of which nothing is left keeps its row with an empty text; a
    text that loses nothing, null too, stays as it is.
    """
    removed, left = free_names(docs, "removed", "left")
    out = remove_repeats(docs, length, names=(None, None, removed, None, left), words=words)
    lost = F.col(removed) > 0
    text = F.when(lost, F.col(left)).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(lost, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
