"""Document fingerprints: 128-bit SimHash in DataFrame functions only.

Terms are neighbouring word pairs (a lone word is a term), weighted by their length up to 16.
Each term's hash votes with its weight on every bit; a bit is set if more than half of the weight
votes for it.  Votes are summed in packed lanes: masking a hash leaves four bits in four 16-bit
lanes, so 16 sums count 64 bits.  Lanes never overflow because votes are first summed in blocks of
``BLOCK`` terms (BLOCK * 16 < 32768, so even the top lane stays a positive long) and unpacked before blocks are added.

Fingerprints within a Hamming radius r are found with r + 1 permuted block tables: two fingerprints
that differ in at most r bits agree on one of r + 1 blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spark_rca.llm.common import materialize, row_key

BLOCK, LANES, MASK = 2047, 16, 0x0001000100010001
BITS = 128


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def terms(found: str) -> Column:
    """array<long>: a hash of each pair of the word column ``found`` whose low four bits hold its weight minus 1."""

    def term(w, after):
        size = F.least(F.length(w) + F.length(after), F.lit(16)) - 1
        return F.xxhash64(w, after).bitwiseAND(F.lit(-16)).bitwiseOR(size.cast("long"))

    n = F.size(found)
    # A lone word pairs with nothing; else the last word only ends a pair.
    first = F.slice(found, 1, F.greatest(n - 1, F.lit(1)))
    second = F.when(n > 1, F.slice(found, 2, F.greatest(n - 1, F.lit(0)))).when(n == 1, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.zip_with(first, second, term)


def fingerprints(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """``key`` columns plus ``hi`` and ``lo``, the two halves of each row's fingerprint.

    ``key`` must be unique.  Texts without a word (null: empty) have the fingerprint 0.  Votes are
    summed in the task that reads the text; only block sums are shuffled, so a text of any length
    spreads no further than one row per block.
    """
    t = rows.select(*key, words(F.coalesce(F.col(text), F.lit(""))).alias("_words"))
    t = t.select(*key, F.posexplode_outer(terms("_words")).alias("_pos", "_term"))
    t = t.select(*key, F.floor(F.col("_pos") / BLOCK).alias("_block"), (F.col("_term").bitwiseAND(F.lit(15)) + 1).alias("_w"), F.xxhash64("_term").alias("_a"), F.xxhash64("_term", F.lit(1)).alias("_b"))
    lane = lambda h, j: F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(MASK)) * F.col("_w"))
    sums = [lane(h, j).alias(f"{h}{j}") for h in ("_a", "_b") for j in range(LANES)]
    blocks = t.groupBy(*key, "_block").agg(F.sum("_w").alias("_all"), *sums)
    count = lambda c, k: F.shiftrightunsigned(F.coalesce(F.col(c), F.lit(0)), 16 * k).bitwiseAND(F.lit(65535))
    bits = {h: [f"{h}{j}" for j in range(LANES)] for h in ("_a", "_b")}
    arrays = [F.flatten(F.array(*[F.array(*[count(c, k) for k in range(4)]) for c in bits[h]])) for h in ("_a", "_b")]
    votes = blocks.select(*key, "_all", F.concat(*arrays).alias("_ones"))
    # Most texts are one block; the rest add up bit by bit.
    whole = votes.groupBy(*key).agg(F.sum("_all").alias("_all"), F.collect_list("_ones").alias("_lists"))
    total = F.aggregate("_lists", F.array_repeat(F.lit(0).cast("long"), BITS), lambda acc, x: F.zip_with(acc, x, lambda p, q: p + q))
    whole = whole.withColumn("_ones", F.when(F.size("_lists") == 1, F.get("_lists", 0)).otherwise(total))

    return whole.select(*key, _pack("_ones", "_all", 0).alias("hi"), _pack("_ones", "_all", 64).alias("lo"))


def _pack(ones: str, total: str, start: int) -> Column:
    """64 votes to a long: lane order 4 * j + k is bit j + 16 * k."""
    part = F.slice(F.col(ones), start + 1, 64)
    places = F.array(*[F.lit(1 << (j + 16 * k) if j + 16 * k < 63 else -(1 << 63)).cast("long") for j in range(LANES) for k in range(4)])
    return F.aggregate(F.zip_with(part, places, lambda v, p: F.when(v * 2 > F.col(total), p).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def to_hex(hi: str = "hi", lo: str = "lo") -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """1 minus the share of differing bits."""
    apart = F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))
    return 1.0 - apart.cast("double") / BITS


def hamming_search(queries: DataFrame, base: DataFrame, radius: int = 3) -> DataFrame:
    """(q_hi, q_lo, hi, lo, distance) for every base fingerprint within ``radius`` of a query's.

    Both tables have ``hi`` and ``lo``; they are made distinct first, so copies of a document cost
    nothing.  Each of the radius + 1 block tables is an equi-join on one block; a pair is kept only
    by the first block on which it agrees, so results are distinct without another shuffle.
    Exact for any radius below 64.  A fingerprint with a null half is near nothing; empty tables give an empty one.
    """
    n = radius + 1
    edges = [round(i * BITS / n) for i in range(n + 1)]

    def block(hi, lo, i):
        a, b = edges[i], edges[i + 1]
        out = []
        for col, s in ((hi, 0), (lo, 64)):
            x, y = max(a, s) - s, min(b, s + 64) - s
            if x < y:
                mask = (1 << (y - x)) - 1
                m = mask << x
                out.append(col.bitwiseAND(F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long")))
        return F.array(*out)

    def blocks(df, p):
        hi, lo = F.col(f"{p}hi"), F.col(f"{p}lo")
        table = F.array(*[F.struct(F.lit(i).alias("i"), F.xxhash64(block(hi, lo, i)).alias("h")) for i in range(n)])
        return df.select(f"{p}hi", f"{p}lo", F.explode(table).alias("_t")).select(f"{p}hi", f"{p}lo", F.col("_t.i").alias(f"{p}i"), F.col("_t.h").alias(f"{p}h"))

    q = blocks(queries.select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo")).distinct(), "q_")
    b = blocks(base.select("hi", "lo").distinct(), "")
    apart = F.bit_count(F.col("q_hi").bitwiseXOR(F.col("hi"))) + F.bit_count(F.col("q_lo").bitwiseXOR(F.col("lo")))
    first = F.lit(True)
    for i in range(n):
        same = block(F.col("q_hi"), F.col("q_lo"), i) == block(F.col("hi"), F.col("lo"), i)
        first = first & ((F.col("i") <= i) | ~same)
    return q.join(b, (F.col("q_i") == F.col("i")) & (F.col("q_h") == F.col("h")) & (apart <= radius) & first).select("q_hi", "q_lo", "hi", "lo", apart.alias("distance"))


def in_order(docs: DataFrame) -> DataFrame:
    """One row per distinct (doc_id, text): ``key``, ``doc_id``, ``n``, ``copies``, ``next_key``, ``prev_key`` and ``prev_n``.

    Order: doc_id (null first), then text hash; after the last comes the first.  Ids, never texts,
    are range partitioned; the ends of the ranges are one row per partition.
    """
    light = docs.select(row_key().alias("key"), "doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    light = light.groupBy("key", "doc_id", "n").agg(F.count("*").alias("copies"))
    light = materialize(light.repartitionByRange(F.col("doc_id").asc_nulls_first()).withColumn("part", F.spark_partition_id()))
    order = [F.col("doc_id").asc_nulls_first(), F.col("key")]
    w = Window.partitionBy("part").orderBy(*order)
    ends = light.groupBy("part").agg(F.min_by("key", F.struct(F.col("doc_id").isNotNull(), "doc_id", "key")).alias("first_key"), F.max_by(F.struct("key", "n"), F.struct(F.col("doc_id").isNotNull(), "doc_id", "key")).alias("last"))
    ring = Window.orderBy("part")
    ends = ends.select("part", F.coalesce(F.lead("first_key").over(ring), F.first("first_key").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"), F.coalesce(F.lag("last").over(ring), F.last("last").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    out = light.join(ends, "part")
    back = F.coalesce(F.lag(F.struct("key", "n")).over(w), F.col("before"))
    return out.withColumn("next_key", F.coalesce(F.lead("key").over(w), F.col("after"))).withColumn("_b", back).select("key", "doc_id", "n", "copies", "next_key", F.col("_b.key").alias("prev_key"), F.col("_b.n").alias("prev_n"))


def fingerprint_query(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts.

    A repeated row (same doc_id and text) is its own next document, except for the last of them.
    A null text is an empty one; an empty table gives an empty one; other columns are dropped.
    """
    order = in_order(docs)
    texts = docs.select(row_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    one = Window.partitionBy("key").orderBy("key")
    rows = texts.join(order, "key").withColumn("_rn", F.row_number().over(one)).where("_rn = 1")
    heads = rows.select(F.col("prev_key").alias("key"), F.expr("substring(text, 1, int(prev_n div 4))").alias("head"))
    stem = "substring(text, 1, int(n - n div 4))"
    both = rows.join(heads, "key").select("key", "doc_id", "n", "copies", "next_key", "text", F.expr(f"concat({stem}, head)").alias("edited"), F.expr(f"CASE WHEN copies > 1 THEN concat({stem}, substring(text, 1, int(n div 4))) END").alias("own"))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")), F.struct(F.lit(2).alias("kind"), F.col("own").alias("t")))
    each = both.select("key", "doc_id", "n", "copies", "next_key", F.explode(kinds).alias("_k")).select("key", "doc_id", "n", "copies", "next_key", F.col("_k.kind").alias("kind"), F.col("_k.t").alias("t")).where("t IS NOT NULL")
    each = each.withColumn("sha", F.when(F.col("kind") > 0, F.sha2(F.col("t"), 256)))
    prints = materialize(fingerprints(each, ["key", "doc_id", "n", "copies", "next_key", "kind", "sha"], "t"))
    own = prints.where("kind = 0").select("key", "doc_id", "n", "copies", "next_key", "hi", "lo")
    edits = prints.where("kind > 0").select("key", "kind", "sha", F.col("hi").alias("e_hi"), F.col("lo").alias("e_lo"))
    after = own.select(F.col("key").alias("next_key"), F.col("hi").alias("n_hi"), F.col("lo").alias("n_lo"))
    out = own.join(edits, "key").join(after, "next_key").withColumn("_times", F.when(F.col("kind") == 1, F.lit(1).cast("long")).otherwise(F.col("copies") - 1))
    out = out.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    c = F.col
    following = F.when(c("kind") == 2, F.lit(1.0)).otherwise(likeness((c("hi"), c("lo")), (c("n_hi"), c("n_lo"))))
    return out.select("doc_id", c("n").alias("n_chars"), c("sha").alias("edited_sha256"), to_hex().alias("fingerprint"), to_hex("e_hi", "e_lo").alias("edited_fingerprint"), likeness((c("hi"), c("lo")), (c("e_hi"), c("e_lo"))).alias("near_edited"), following.alias("near_next"))
