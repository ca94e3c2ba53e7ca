"""Exact n-gram Jaccard join in the metric space of shingle sets.

Jaccard distance is a metric, but nearly every pair of documents is at distance 1, where no pivot parts
anything.  So first each set counts how many of its shingles another set has too: a set that links
has at least ``percent`` in a hundred of them, and all others are alone.  The rest is joined by pivots.

1. Pivots and regions.  Of n shingles, a set takes its n - ceil(n * percent / 100) + 1 rarest.  Two linked
   sets have one of these in common; the least set that takes a shingle is a pivot, and its region
   holds all sets that take one of its shingles.  So each linked pair meets in the region of a pivot, and
   all other pivots of the corpus are too far off to matter.
2. Division.  A region's pivot and further ones chosen in it give Voronoi regions: each set goes
   to that of its nearest pivot p, and also to that of any pivot q within the window d(x, q) <= d(x, p) + 2 eps
   by the triangle inequality, so no linked pair is parted.  Sets within eps of a pivot link to it; pairs
   that links connect already are not tested, and regions recurse until all their sets are connected or tested.
   Large regions do this as joins, others inside a task.

Every link that is used is verified on the full sets, and no link between different texts is lost for
the components.  Equal sets are joined first, by a 128-bit set hash, whatever their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spark_rca.llm.bytehash import LOWER, batches, mix, prefix, span, words
from spark_rca.llm.common import connected_components, lean, materialize, small_side

#: The most sets that one task joins locally, and the most bytes of theirs.
LOCAL, LOCAL_BYTES = 1500, 16 << 20
#: Shingles that are made unique together, and bytes of all texts for each bucket of shingle keys.
CHUNK, PER_BUCKET = 1 << 20, 12 << 20

def shingles(data: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text; a text with fewer words is one shingle; without words: none."""
    starts, ends, first = words(data, offs)
    h = span(prefix(data, LOWER), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    out = []
    salt = np.uint64(0xD6E8FEB86659FD93)
    rolled = h
    for k in range(1, width):
        rolled = mix(rolled[: len(h) - k] * salt + h[k:]) if len(h) > k else h[:0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        if n >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif n:
            v = h[a : a + 1]
            for k in range(1, n):
                v = mix(v * salt + h[a + k : a + k + 1])
            out.append(mix(v + np.uint64(n)))
        else:
            out.append(h[:0])
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    i = np.searchsorted(b, a)
    i[i == len(b)] = 0
    return int((b[i] == a).sum())


def links_of(inter: np.ndarray | int, na, nb, percent: int):
    return 100 * inter >= percent * (na + nb - inter)


class Union:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def pivot_join(sets: list[np.ndarray], percent: int, labels: list | None = None, leaf: int = 8, pivots: int = 8) -> list[tuple[int, int]]:
    """Links (i, j) that connect exactly what all links between the sets connect.

    Sets with the same label are known to be connected.  Pairs that are connected already are not
    tested, so a tight group costs one pass to a pivot.
    """
    eps, out, joined = 1 - percent / 100, [], Union(len(sets))
    seen: dict = {}
    for i, x in enumerate(labels if labels is not None else []):
        joined.join(i, seen.setdefault(x, i))
    size = np.array([len(x) for x in sets], np.int64)

    def index(members):
        flat = np.concatenate([sets[i] for i in members])
        owner = np.repeat(np.arange(len(members)), size[members])
        order = np.argsort(flat, kind="stable")
        return flat[order], owner[order]

    def overlaps(i, members, flat, owner):
        a, b = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        n = b - a
        hit = owner[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        inter = np.bincount(hit, minlength=len(members))
        for k in np.flatnonzero(links_of(inter, size[members], size[i], percent)).tolist():
            if joined.join(i, int(members[k])):
                out.append((i, int(members[k])))
        return 1 - inter / (size[members] + size[i] - inter)

    def region(members):
        if len({joined.find(int(i)) for i in members}) < 2:
            return
        flat, owner = index(members)
        brute = len(members) <= leaf
        if not brute:
            chosen = [int(members[k]) for k in np.unique(np.linspace(0, len(members) - 1, pivots).astype(int))]
            dist = np.stack([overlaps(p, members, flat, owner) for p in chosen])
            near, best = dist.argmin(0), dist.min(0)
            cells = []
            for k in range(len(chosen)):
                home = near == k
                # Triangle inequality: who can link with a home document of k is in the window.
                edge = dist[k][home].max() + eps if home.any() else -1.0
                cells.append(members[home | ((dist[k] <= best + 2 * eps + 1e-9) & (dist[k] <= edge + 1e-9))])
            brute = max(map(len, cells)) > 0.8 * len(members)
        if brute:
            for i in members.tolist():
                overlaps(i, members, flat, owner)
        else:
            for c in cells:
                if len(c) > 1:
                    region(c)

    live = np.flatnonzero(size > 0)
    if len(live):
        region(live)
    return out


def set_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; 0 for an empty one."""
    h1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
    h2 = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64)
    return h1.view(np.int64), h2.view(np.int64)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2) of each row."""

    def run(it):
        for b in it:
            col, at = b.column("text"), 0
            for _, data, offs in batches(col):
                sets = shingles(data, offs, width)
                h1, h2 = set_hashes(sets)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1), pa.array(h2)],
                    ["doc_id", "n_shingles", "h1", "h2"],
                )
                at += len(sets)

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_shingles long, h1 long, h2 long")


def chunk_keys(sets: list[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """What a chunk of texts tells the others: (set hashes, own counts, per bucket the 40-bit keys and their owners).

    Each key leaves a chunk once, however many of its sets have it.  A key of one set carries that set's
    number; one of several sets is shared already, counts at once, and carries -1.
    """
    h1, _ = set_hashes(sets)
    keep = np.array(sorted(i for i in np.unique(h1, return_index=True)[1].tolist() if len(sets[i])), np.int64)
    own = [sets[i] for i in keep.tolist()]
    size = np.array([len(s) for s in own], np.int64)
    key = np.concatenate([*own, np.zeros(0, np.uint64)]) >> np.uint64(24)
    order = np.argsort(key)
    key, owner = key[order], np.repeat(np.arange(len(own)), size)[order].astype(np.int32)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(key)))
    counts = np.bincount(owner[np.repeat(times > 1, times)], minlength=len(own))
    key, owner = key[first], np.where(times > 1, np.int32(-1), owner[first]) if len(first) else owner[:0]
    cut = np.searchsorted(key, np.array([-(-(b << 40) // buckets) for b in range(buckets + 1)], np.uint64))
    return h1[keep], counts, [(b, key[x:y], owner[x:y]) for b, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if y > x]


def shared_counts(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """(h1, c): how many shingles of each set are also in a different set; sets without one are left out.

    Keys are dealt by value.  Equal keys of different shingles only raise a count, and a key that very
    many sets have reaches its bucket once for each chunk.
    """

    names = ["bucket", "chunk", "keys", "owners", "hashes", "counts"]
    back = ["chunk", "hashes", "counts"]

    def send(it):
        held, size = [], 0
        for b in it:
            for _, data, offs in batches(b.column("text"), 1 << 20):
                for s in shingles(data, offs, width):
                    held.append(s)
                    size += len(s)
                if size >= CHUNK:
                    yield from tell(held)
                    held, size = [], 0
        if size:
            yield from tell(held)

    def tell(sets):
        hashes, counts, parts = chunk_keys(sets, buckets)
        wide = np.uint16 if len(hashes) < 65_535 else np.uint32
        for k, (bucket, key, owner) in enumerate(parts):
            used, short = np.unique(owner, return_inverse=True)
            packed = key.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
            # -1 has the hash 0 and place 0 in its table.
            table = np.where(used < 0, 0, hashes[used])
            row = [bucket, int(hashes.sum()), packed, short.astype(wide).tobytes(), table.tobytes(), None]
            if k == 0:
                some = np.flatnonzero(counts)
                row[5] = np.concatenate([hashes[some], counts[some]]).astype(np.int64).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int32(), pa.int64(), *[pa.binary()] * 4], strict=True)], names)

    def settle(rows):
        """What a bucket tells each chunk: (chunk, set hashes, how many of their shingles here are shared)."""
        keys, places, tables, out = [], [], [], []
        for chunk, packed, owners, table, counts in rows:
            n = len(packed) // 5
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :5] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
            keys.append(wide.view(np.uint64).ravel())
            places.append(np.frombuffer(owners, np.uint16 if len(owners) == 2 * n else np.uint32))
            tables.append(np.frombuffer(table, np.int64))
            if counts:
                h, c = np.frombuffer(counts, np.int64).reshape(2, -1)
                out.append((chunk, h, c))
        key, h = np.concatenate(keys), np.concatenate([t[x] for t, x in zip(tables, places, strict=True)])
        order = np.argsort(key)
        key, by = key[order], h[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        lo, hi = np.minimum.reduceat(by, first), np.maximum.reduceat(by, first)
        none = np.logical_or.reduceat(by == 0, first)
        shared = np.empty(len(key), bool)
        shared[order] = np.repeat((lo != hi) | none, np.diff(np.append(first, len(key))))
        at = 0
        for (chunk, *_), table, x in zip(rows, tables, places, strict=True):
            n = np.bincount(x[shared[at : at + len(x)]], minlength=len(table))
            at += len(x)
            some = np.flatnonzero((n > 0) & (table != 0))
            out.append((chunk, table[some], n[some]))
        cols = [[c for c, *_ in out], [h.tobytes() for _, h, _ in out], [n.astype(np.int32).tobytes() for *_, n in out]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.binary(), pa.binary()], strict=True)], back)

    def receive(it):
        held, at = [], None
        for b in it:
            for bucket, *row in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if held and bucket != at:
                    yield settle(held)
                    held = []
                held.append(row)
                at = bucket
        if held:
            yield settle(held)

    def total(rows):
        h = np.concatenate([np.frombuffer(x, np.int64) for x, _ in rows])
        u, of = np.unique(h, return_inverse=True)
        n = np.zeros(len(u), np.int64)
        np.add.at(n, of, np.concatenate([np.frombuffer(c, np.int32) for _, c in rows]))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], ["h1", "c"])

    def gather(it):
        held, at = [], None
        for b in it:
            for chunk, *row in zip(*(b.column(c).to_pylist() for c in back), strict=True):
                if held and chunk != at:
                    yield total(held)
                    held = []
                held.append(row)
                at = chunk
        if held:
            yield total(held)

    sent = docs.select("text").mapInArrow(lean(send), "bucket int, chunk long, keys binary, owners binary, hashes binary, counts binary")
    dealt = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    told = dealt.mapInArrow(lean(receive), "chunk long, hashes binary, counts binary").repartition("chunk").sortWithinPartitions("chunk")
    # Equal sets have the same count in every chunk.
    return told.mapInArrow(lean(gather), "h1 long, c long").groupBy("h1").agg(F.max("c").alias("c"))


def _candidates(docs: DataFrame, per: DataFrame, width: int, percent: int) -> DataFrame:
    """(sid, m, s): the sets of which enough shingles are in another set, as sorted 64-bit hashes."""
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    counts = shared_counts(docs, width, max(8, -(-total // PER_BUCKET)))
    chosen = materialize(per.join(counts, "h1").where(F.col("c") * 100 >= F.col("n_shingles") * percent).select(F.col("rep").alias("doc_id"), F.col("h1").alias("_sid")))

    def run(it):
        for b in it:
            want, at = b.column("_sid").to_numpy(), 0
            for _, data, offs in batches(b.column("text")):
                sets = shingles(data, offs, width)
                fit = np.flatnonzero(set_hashes(sets)[0] == want[at : at + len(sets)]).tolist()
                ids = want[at : at + len(sets)][fit]
                at += len(sets)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([len(sets[i]) for i in fit], pa.int32()), pa.array([sets[i].tobytes() for i in fit], pa.binary())], ["sid", "m", "s"])

    texts = docs.select("doc_id", "text").join(small_side(chosen), "doc_id").select("_sid", "text")
    out = materialize(texts.mapInArrow(lean(run), "sid long, m int, s binary"))
    # Repeated rows of one document give a set more than once.
    return out if out.count() == chosen.count() else materialize(out.dropDuplicates(["sid"]))


def pivot_regions(cand: DataFrame, percent: int) -> DataFrame:
    """(region, sid): the regions, named by their pivot, that each candidate is in."""

    def run(it):
        for b in it:
            for sid, m, s in zip(b.column("sid").to_pylist(), b.column("m").to_pylist(), b.column("s").to_pylist(), strict=True):
                k = np.frombuffer(s, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full(m, sid)), pa.array(np.full(m, m, np.int32))], ["k", "sid", "m"])

    keys = cand.mapInArrow(lean(run), "k long, sid long, m int")
    often = keys.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    rows = keys.join(often, "k")
    mine = Window.partitionBy("sid")
    place = F.row_number().over(mine.orderBy("n", "k"))
    # Shingles of one set come before the counted ones in the order of rareness.
    first = F.col("m") - F.ceil(F.col("m") * percent / 100) + 1 - (F.col("m") - F.count("*").over(mine))
    taken = materialize(rows.withColumn("_first", first).withColumn("_r", place).where("_r <= _first").select("k", "sid"))
    pivot = taken.groupBy("k").agg(F.min("sid").alias("region"), F.count("*").alias("n")).where("n > 1").select("k", "region")
    return materialize(taken.join(pivot, "k").select("region", "sid").distinct())


def _region_links(members: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) inside regions that fit a task; ``members`` has region, sid, label and s."""

    def links(rows):
        ids = [r[1] for r in rows]
        found = pivot_join([np.frombuffer(r[3], np.uint64) for r in rows], percent, [r[2] for r in rows])
        return [(ids[i], ids[j]) for i, j in found]

    def run(it):
        held = []
        for b in it:
            out = []
            for r in zip(*(b.column(c).to_pylist() for c in ("region", "sid", "label", "s")), strict=True):
                if held and held[-1][0] != r[0]:
                    out += links(held)
                    held = []
                held.append(r)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
        if held and (out := links(held)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    # The pivot is the least id of its region: it comes first.
    return members.select("region", "sid", "label", "s").repartition("region").sortWithinPartitions("region", "sid").mapInArrow(lean(run), "a long, b long")


def _distances(spread: DataFrame, percent: int) -> DataFrame:
    """Distance of each set to a pivot, and whether they link."""

    def run(it):
        for b in it:
            d, linked, at, p = [], [], None, None
            for pid, p_s, s in zip(*(b.column(c).to_pylist() for c in ("pivot", "p_s", "s")), strict=True):
                if pid != at:
                    at, p = pid, np.frombuffer(p_s, np.uint64)
                x = np.frombuffer(s, np.uint64)
                c, both = common(x, p), len(x) + len(p)
                d.append(1 - c / max(1, both - c))
                linked.append(bool(100 * c >= percent * (both - c)))
            yield pa.RecordBatch.from_arrays([b.column("region"), b.column("sid"), b.column("pivot"), pa.array(d, pa.float64()), pa.array(linked, pa.bool_())], ["region", "sid", "pivot", "d", "linked"])

    return spread.select("region", "sid", "pivot", "p_s", "s").mapInArrow(lean(run), "region long, sid long, pivot long, d double, linked boolean")


def _deal(region: DataFrame, limit: int) -> DataFrame:
    """Regions that pivots do not part, as pairs of blocks that fit a task.

    ``region`` has region, sid, label and weight w.  Sets of one label are connected already: a large
    label has blocks of its own, which are not paired with each other; small labels share blocks.
    Each other pair of blocks becomes a region, so each pair of sets of different labels meets.
    """
    half = limit // 2
    count = region.groupBy("region", "label").agg(F.sum("w").alias("_c"))
    own = F.col("_c") > half // 8
    rest = count.groupBy("region").agg(F.sum(F.when(~own, F.col("_c"))).alias("_rest"))
    docs = region.join(count, ["region", "label"]).join(rest, "region")
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / half)).cast("int")
    docs = docs.withColumn("_home", F.when(own, F.col("label")))
    docs = docs.withColumn("_b", F.when(own, F.xxhash64("label", F.pmod(F.xxhash64("sid"), parts(F.col("_c"))))).otherwise(F.pmod(F.xxhash64("label"), parts(F.coalesce("_rest", F.lit(0))))))
    docs = materialize(docs.select("region", "sid", "label", "_home", "_b"))
    one = docs.select("region", "_b", "_home").distinct()
    two = one.select("region", F.col("_b").alias("_b2"), F.col("_home").alias("_home2"))
    alone = one.groupBy("region").agg(F.count("*").alias("_blocks"))
    apart = F.col("_home").isNull() | F.col("_home2").isNull() | (F.col("_home") != F.col("_home2"))
    pairs = one.join(two, "region").join(alone, "region").where((F.col("_b") < F.col("_b2")) & apart | (F.col("_b") == F.col("_b2")) & (F.col("_blocks") == 1))
    pairs = pairs.select("region", F.xxhash64("region", "_b", "_b2").alias("_pair"), F.explode(F.array_distinct(F.array("_b", "_b2"))).alias("_b"))
    return docs.join(pairs, ["region", "_b"]).select(F.col("_pair").alias("region"), "sid", "label")


#: A region is parted by its pivots if no cell, with its window, keeps more than this share of it.
PARTED = 0.8


def _split_regions(members: DataFrame, percent: int, limit: int, pivots: int = 8, rounds: int = 20) -> tuple[DataFrame, list[DataFrame]]:
    """Recursion over regions of a weight over ``limit``, as joins with their pivots.

    ``members`` has region, sid, label, s and w, the weight: 1 for each set, more for a long one.
    Returns the members of regions that fit a task, and the links to pivots found on the way.  After
    each round, cells whose sets are all connected are done.  Where a cell keeps nearly all of its
    region (all sets are about as far from each other as the window is wide), where one connected
    group leaves few others, and after ``rounds``, the sets are dealt in blocks: more work, the same links.
    """
    eps, links, done = 1 - percent / 100, [], []
    for k in range(rounds):
        size = members.groupBy("region").agg(F.sum("w").alias("_n")).where(F.col("_n") > limit)
        size = materialize(size)
        many = size.count()
        if not many:
            done.append(members)
            break
        few_rows = F.broadcast(size) if many <= 100_000 else size
        done.append(members.join(few_rows, "region", "left_anti"))
        big = members.join(few_rows.select("region"), "region")
        # The sets of least hash, by salted minima: one task never sorts a region.  At first that hash is
        # the set's own, so the region's pivot is among them.
        h = F.xxhash64("sid", F.lit(k)) if k else F.col("sid")
        chosen = big.groupBy("region", F.pmod(F.xxhash64("sid", F.lit(k)), F.lit(pivots)).alias("_salt")).agg(F.min_by(F.struct("sid", "s"), h).alias("p"))
        chosen = materialize(chosen.select("region", F.col("p.sid").alias("pivot"), F.col("p.s").alias("p_s")))
        small = many * pivots <= 2000 and (chosen.agg(F.sum(F.length("p_s"))).first()[0] or 0) < 32 << 20
        near = materialize(_distances(big.join(F.broadcast(chosen) if small else chosen, "region"), percent))
        links.append(near.where("linked AND sid <> pivot").select(F.col("pivot").alias("a"), F.col("sid").alias("b")))
        known = links[0]
        for x in links[1:]:
            known = known.unionByName(x)
        group = connected_components(known).withColumnRenamed("node", "sid")
        best = near.groupBy("region", "sid").agg(F.min(F.struct("d", "pivot")).alias("m"))
        near = near.join(best, ["region", "sid"]).join(big.select("region", "sid", "w"), ["region", "sid"])
        edge = near.where(F.col("m.pivot") == F.col("pivot")).groupBy("region", "pivot").agg(F.max("d").alias("edge"))
        cells = near.join(edge, ["region", "pivot"]).where((F.col("m.pivot") == F.col("pivot")) | ((F.col("d") <= F.col("m.d") + 2 * eps + 1e-9) & (F.col("d") <= F.col("edge") + eps + 1e-9)))
        cells = cells.select(F.col("region").alias("parent"), F.xxhash64("region", "pivot").alias("region"), (F.col("m.pivot") == F.col("pivot")).alias("home"), "sid", "w").join(group, "sid", "left")
        cells = materialize(cells.withColumn("label", F.coalesce("component", "sid")).drop("component"))
        per = cells.groupBy("parent", "region", "label").agg(F.sum("w").alias("c"), F.sum(F.when(F.col("home"), F.col("w")).otherwise(0)).alias("h"))
        per = per.groupBy("parent", "region").agg(F.sum("c").alias("n"), F.sum("h").alias("h"), F.count("*").alias("labels"), F.max("c").alias("top"))
        whole = per.groupBy("parent").agg(((F.max("n") > F.sum("h") * PARTED) & (F.max("n") > limit)).alias("stuck"))
        per = materialize(per.where("labels > 1").join(whole, "parent"))
        per = per.select("region", "stuck", ((F.col("n") > limit) & (F.col("n") - F.col("top") <= limit // 2)).alias("few"))
        cells = cells.join(small_side(per), "region")
        # A region that is not parted is taken once, by its home documents.
        stuck = cells.where("stuck").select(F.col("parent").alias("region"), "sid", "label", "w").distinct()
        dealt = _deal(stuck.unionByName(cells.where("few AND NOT stuck").select("region", "sid", "label", "w")), limit)
        rest = cells.where("NOT stuck AND NOT few").select("region", "sid", "label")
        texts = materialize(big.select("sid", "s", "w").dropDuplicates(["sid"]))
        done.append(materialize(dealt.join(texts, "sid").select("region", "sid", "label", "s", "w")))
        members = materialize(rest.join(texts, "sid").select("region", "sid", "label", "s", "w"))
    else:
        over = members.groupBy("region").agg(F.sum("w").alias("_n")).where(F.col("_n") > limit).select("region")
        over = small_side(materialize(over))
        done.append(members.join(over, "region", "left_anti"))
        big = members.join(over, "region", "left_semi")
        texts = materialize(big.select("sid", "s", "w").dropDuplicates(["sid"]))
        done.append(materialize(_deal(big.select("region", "sid", "label", "w"), limit).join(texts, "sid").select("region", "sid", "label", "s", "w")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d.select(out.columns))
    return out, links


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, local: int = LOCAL) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id long, text).

    Null and empty texts, and texts of white space, have no shingles and are linked with nothing;
    their component is their own id.  Repeated rows and equal texts share a component.  Rows with one
    doc_id and different texts are one document and connect what either links to.  A null doc_id stays
    null and links nothing.  Other columns are not read; an empty table gives an empty one.
    """
    docs = docs.select("doc_id", "text")
    sets = materialize(_sets(docs, width))
    full = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    per = materialize(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles")))
    cand = _candidates(docs.where("doc_id IS NOT NULL"), per, width, percent)
    regions = pivot_regions(cand, percent)
    members = materialize(cand.join(small_side(regions), "sid").select("region", "sid", F.col("sid").alias("label"), "s", F.greatest(F.lit(1), F.ceil(F.length("s") * (local / LOCAL_BYTES))).cast("long").alias("w")))
    small, found = _split_regions(members, percent, local)
    links = _region_links(small, percent)
    for x in found:
        links = links.unionByName(x)
    # Texts of one document that differ are connected by it.
    several = full.groupBy("doc_id").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("doc_id", "a")
    links = materialize(links.distinct()).unionByName(full.join(several, "doc_id").select("a", F.col("h1").alias("b")).distinct())
    comp = connected_components(links).withColumnRenamed("node", "h1")
    known = per.join(comp, "h1", "left").where("copies > 1 OR component IS NOT NULL").select("h1", "h2", "rep", F.coalesce("component", "h1").alias("_g"))
    known = materialize(known)
    least = known.groupBy("_g").agg(F.min("rep").alias("component_id"))
    known = materialize(known.join(least, "_g").select("h1", "h2", "component_id"))
    out = sets.join(small_side(known), ["h1", "h2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Pipeline stage: of each group of near copies the document of least id stays, with its columns unchanged.

    Rows that repeat an id keep one row for each different text of it; rows without an id all stay, as
    do documents without words.
    """
    comp = jaccard_components(docs, width, percent)
    keep = materialize(comp.where("doc_id = component_id").select(F.col("doc_id").alias("_keep")).distinct())
    cols = docs.columns
    one = docs.join(keep, docs["doc_id"] == keep["_keep"], "left_semi")
    again = materialize(one.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_keep")))
    if again.take(1):
        twice = one.join(small_side(again), one["doc_id"] == again["_keep"], "left_semi").dropDuplicates(["doc_id", "text"])
        one = one.join(small_side(again), one["doc_id"] == again["_keep"], "left_anti").unionByName(twice)
    return one.unionByName(docs.where(F.col("doc_id").isNull())).select(cols)
