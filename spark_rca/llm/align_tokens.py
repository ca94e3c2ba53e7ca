"""Cross-tokenizer alignment with Arrow kernels: which tokens of two tokenizers cover the same bytes.

A task encodes some texts with both tokenizers and keeps going in Arrow: lists of ids are flattened with their
parent indices, a cumulative sum of token lengths less that of the text's first token gives each token's end, and an Acero
join of both tokenizers' (text, end) keys finds the ends they share, which cut a text into groups.  Sorted by
text and end, the joined rows are the pieces between neighbouring ends of either side, and filled backward each
names the one A token and the one B token over it: the links, for two ranges overlap in one piece at most.

Table.group_by counts each text's pairs, then the texts of each pair in a task; Spark merges these counts over the corpus.
The most frequent pairs, as many as may be broadcast, are looked up in tasks; links of all others join by a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from spark_rca.llm.bytehash import batches
from spark_rca.llm.common import BROADCAST_ROWS, free_names, lean, materialize, small_side

#: The blank of the second tokenizer's pieces.
BLANK = "▁"
#: White space in a row for which the pattern's engine may run out of steps.
MANY = 10_000


def byte_alphabet() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones of Latin-1 as they are, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Pair:
    """Both tokenizers with the bytes of each of their tokens.

    With ``pattern``, a vocabulary whose merges make tokens in the order of their ids is encoded by these ids as ranks,
    with the same ids in a third of the time; texts with very long runs of white space, and other vocabularies, take the tokenizer itself.
    """

    def __init__(self, byte_level: str, pieces: bytes, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        letters = byte_alphabet()
        self.a_bytes = [b""] * (1 + max(self.a.get_vocab().values()))
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:-1], 16)]) if self.b.is_byte(i) else x.replace(BLANK, " ").encode() for i, x in enumerate(names)]
        self.ranked = None
        made = [self.a.token_to_id("".join(m.split(" ") if isinstance(m, str) else m)) for m in json.loads(byte_level)["model"]["merges"]]
        if pattern is not None and all(x < y for x, y in pairwise(made)) and sorted(made) == list(range(256, 256 + len(made))):
            import tiktoken

            ranks = {t: i for i, t in enumerate(self.a_bytes[: 256 + len(made)])}
            self.ranked = tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = [pa.array([len(x) for x in side], pa.int64()) for side in (self.a_bytes, self.b_bytes)]

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        if self.ranked is None or any(len(t) > MANY and re.search(rf"\s{{{MANY}}}", t) for t in texts):
            return [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        return [self.ranked.encode_ordinary(t) for t in texts]

    def encode(self, texts: list[str]) -> tuple[pa.Array, pa.Array]:
        """The ids of each text by A (of a blank and the text) and by B; none where either side's bytes are not those of blank and text."""
        full = [" " + t for t in texts]
        ids = [self.encode_a(full), self.b.encode(texts, num_threads=1)]
        for k, t in enumerate(full):
            raw = t.encode()
            if not texts[k] or any(b"".join([names[i] for i in side[k]]) != raw for side, names in zip(ids, (self.a_bytes, self.b_bytes), strict=True)):
                ids[0][k] = ids[1][k] = []
        return tuple(pa.array(side, pa.list_(pa.int32())) for side in ids)


def _ends(ids: pa.Array, sizes: pa.Array, name: str) -> tuple[pa.Array, pa.Table]:
    """Flat ids, and the rows (text, end, number of the token) of a column of id lists."""
    flat, text = pc.list_flatten(ids), pc.list_parent_indices(ids)
    total = pc.cumulative_sum(pc.take(sizes, flat))
    before = pc.take(pa.concat_arrays([pa.array([0], pa.int64()), total]), ids.offsets.slice(0, len(ids)))
    end = pc.subtract(total, pc.take(before, text))
    return flat, pa.table({"text": text, "end": end, name: pa.array(np.arange(len(flat)), pa.int64())})


def align(a: pa.Array, b: pa.Array, sizes: list[pa.Array]) -> tuple[pa.Table, pa.Array, pa.Array]:
    """(links, groups, texts) of two columns of id lists: a row (text, ia, ib) per link, each text's groups, their number.

    A text's groups are written `a1,a2|b1;a3|b2,b3`.
    """
    flat_a, rows_a = _ends(a, sizes[0], "ia")
    flat_b, rows_b = _ends(b, sizes[1], "ib")
    joined = rows_a.join(rows_b, ["text", "end"], join_type="full outer", use_threads=False).sort_by([("text", "ascending"), ("end", "ascending")])
    ia, ib = (joined[c].combine_chunks() for c in ("ia", "ib"))
    shared = pc.and_(pc.is_valid(ia), pc.is_valid(ib))
    links = pa.table({"text": joined["text"], "a": pc.take(flat_a, pc.fill_null_backward(ia)), "b": pc.take(flat_b, pc.fill_null_backward(ib))})

    def lists(at, flat):
        cut = pc.add(pc.filter(at, shared), 1).cast(pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), cut]), flat.cast(pa.string())), ",")

    group = pc.binary_join_element_wise(lists(ia, flat_a), lists(ib, flat_b), "|")
    count = np.bincount(pc.filter(joined["text"], shared).to_numpy(), minlength=len(a))
    bounds = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
    return links, pc.binary_join(pa.ListArray.from_arrays(bounds, group), ";"), pa.array(count, pa.int64())


#: Names and kinds of what ``align_documents`` adds.
ADDED = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups": "string", "n_best": "long", "count_sum": "long"}

_PAIRS: dict[str, Pair] = {}


def _tokenizers(key: str, byte_level: str, pieces: bytes, pattern: str | None) -> Pair:
    """One pair per Python worker; a worker serves many tasks."""
    if key not in _PAIRS:
        _PAIRS[key] = Pair(byte_level, pieces, pattern)
    return _PAIRS[key]


def _merged_counts(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("code", use_threads=False).aggregate([("n", "sum")]).rename_columns(["code", "n"])


def pair_counts(linked: DataFrame, width: int, codes: str, flush: int = 1_000_000) -> DataFrame:
    """(code, n, best): in how many texts each pair is linked, and whether none of its A id's pairs is in more.

    A task merges its counts and hands them on when it holds more than ``flush`` pairs.  ``width`` is the number of B ids.
    """

    def count(it):
        held, rows = [], 0
        for b in it:
            flat = pc.list_flatten(b.column(0)).cast(pa.int64())
            held.append(pa.table({"code": flat}).group_by("code", use_threads=False).aggregate([([], "count_all")]).rename_columns(["code", "n"]))
            rows += len(held[-1])
            if rows > 2 * flush:
                held = [_merged_counts(held)]
                rows = len(held[0])
                if rows > flush:
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if held:
            yield from _merged_counts(held).to_batches()

    n = materialize(linked.select(codes).mapInArrow(lean(count), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))
    most = small_side(materialize(n.groupBy(F.floor(F.col("code") / width).alias("a")).agg(F.max("n").alias("most"))))
    return materialize(n.withColumn("a", F.floor(F.col("code") / width)).join(most, "a").select("code", "n", (F.col("n") == F.col("most")).alias("best")))


def least_frequent_hot(counts: DataFrame, rows: int) -> int:
    """The least power of two so that at most ``rows`` pairs are in so many texts or more."""
    sizes = {r["k"]: r["c"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("c")).collect()}
    k = max(sizes, default=0) + 1
    total = 0
    while k > 0 and total + sizes.get(k - 1, 0) <= rows:
        k -= 1
        total += sizes.get(k, 0)
    return 1 << k


def align_documents(spark: SparkSession, docs: DataFrame, byte_level: str, pieces: str, pattern: str | None = None, digest: bool = False, hot: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` (text, ...), without the text, with how its tokens by two tokenizers align.

    A is a byte-level BPE file (JSON) that encodes a blank and the text (``pattern``, see ``Pair``, splits text as it does), B a piece model file that adds the blank itself.  Added are ``n_a``,
    ``n_b``, ``n_groups``, ``n_links``, ``groups`` (see ``align``; with ``digest`` the lowercase hex SHA-256 of it), ``n_best``
    (links whose pair is in as many texts as any pair of its A id) and ``count_sum`` (over links, the texts that their
    pairs are in).  At most ``hot`` pairs are broadcast.

    Texts that are null or empty, or that a tokenizer does not give back byte for byte, have no tokens: zeros and empty
    ``groups``, not hashed.  Each row is a text of its own, also if it repeats; an empty table gives an empty one.  Other columns stay as they are; those of
    the added names are replaced.  Both files have a fixed size and are broadcast.
    """
    with open(byte_level, encoding="utf-8") as f, open(pieces, "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read(), pattern))
    key = f"{byte_level}\n{pieces}\n{pattern}"
    pair = _tokenizers(key, *files.value)
    width, code_type = len(pair.b_bytes), LongType() if len(pair.a_bytes) * len(pair.b_bytes) >= 1 << 31 else IntegerType()
    code_arrow = pa.int64() if code_type == LongType() else pa.int32()
    cols = [c for c in docs.columns if c.lower() not in ADDED and c != "text"]
    row_, text_, codes_, times_, sum_, best_ = free_names(docs, "row", "text", "codes", "times", "sum", "best")
    stats = ["n_a", "n_b", "n_groups", "n_links", "groups"]
    own = StructType([*docs.select(cols).schema.fields])
    schema = StructType([*own.fields])
    for name in stats:
        schema = schema.add(name, ADDED[name])
    schema = schema.add(codes_, ArrayType(code_type)).add(times_, ArrayType(IntegerType()))

    def solve(it):
        both = _tokenizers(key, *files.value)
        for batch in it:
            t = pa.Table.from_batches([batch])
            for start, data, offs in batches(t[text_], 1 << 18):
                part = t.slice(start, len(offs) - 1)
                a, b = both.encode([x or "" for x in part[text_].to_pylist()])
                links, groups, n_groups = align(a, b, both.sizes)
                code = pc.add(pc.multiply(links["a"].cast(pa.int64()), width), links["b"].cast(pa.int64()))
                per = pa.table({"text": links["text"], "code": code}).group_by(["text", "code"], use_threads=False).aggregate([([], "count_all")])
                per = per.sort_by([("text", "ascending"), ("code", "ascending")])
                bounds = pa.array(np.searchsorted(per["text"].to_numpy(), np.arange(len(a) + 1)), pa.int32())
                n_links = np.bincount(links["text"].to_numpy(), minlength=len(a))
                if digest:
                    groups = pa.array([x and hashlib.sha256(x.encode()).hexdigest() for x in groups.to_pylist()], pa.string())
                part = part.select(cols)
                values = [pc.list_value_length(a).cast(pa.int64()), pc.list_value_length(b).cast(pa.int64()), n_groups, pa.array(n_links, pa.int64()), groups]
                values += [pa.ListArray.from_arrays(bounds, per[c].combine_chunks().cast(kind)) for c, kind in (("code", code_arrow), ("count_all", pa.int32()))]
                for name, v in zip([*stats, codes_, times_], values, strict=True):
                    part = part.append_column(name, v)
                yield from part.to_batches()

    read = docs.select(*cols, F.col("text").alias(text_))
    # Written with its row number, which is then fixed.
    linked = materialize(read.mapInArrow(lean(solve), schema).withColumn(row_, F.monotonically_increasing_id()))
    counts = pair_counts(linked, width, codes_)
    floor = least_frequent_hot(counts, hot)
    known = counts.where(F.col("n") >= floor).toArrow()
    order = np.argsort(known["code"].to_numpy())
    table = spark.sparkContext.broadcast(tuple(known[c].to_numpy()[order] for c in ("code", "n", "best")))
    result = StructType([*own.fields])
    for name in stats:
        result = result.add(name, ADDED[name])
    result = result.add(row_, "long").add(best_, "long").add(sum_, "long").add(codes_, ArrayType(code_type)).add(times_, ArrayType(IntegerType()))

    def look_up(it):
        code, n, best = table.value
        for batch in it:
            t = pa.Table.from_batches([batch])
            codes, times = (t[c].combine_chunks() for c in (codes_, times_))
            at, want, c = codes.offsets.to_numpy(), codes.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            at = at - at[0]
            i = np.searchsorted(code, want)
            found = np.zeros(len(want), bool)
            found[i < len(code)] = code[i[i < len(code)]] == want[i < len(code)]
            i = np.where(found, i, 0)
            sums = [c * found * x[i] if len(x) else c * 0 for x in (best, n)]
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in sums]
            left = np.concatenate([[0], np.cumsum(~found)])[at]
            t = t.select([*cols, *stats, row_])
            for name, x in zip((best_, sum_), sums, strict=True):
                t = t.append_column(name, pa.array(x[at[1:]] - x[at[:-1]], pa.int64()))
            for name, x, kind in ((codes_, want, code_arrow), (times_, c, pa.int32())):
                t = t.append_column(name, pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(x[~found], kind)))
            yield from t.to_batches()

    part = linked.mapInArrow(lean(look_up), result)
    if floor > 1:
        part = materialize(part)
        rare = part.select(row_, F.explode(F.arrays_zip(F.col(codes_).alias("code"), F.col(times_).alias("times"))).alias("x")).select(row_, F.col("x.code").cast("long").alias("code"), "x.times")
        rare = rare.join(counts.where(F.col("n") < floor), "code")
        rare = rare.groupBy(row_).agg(F.sum(F.col("times") * F.col("n")).alias("_s"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_b"))
        part = part.join(rare, row_, "left").withColumn(best_, F.col(best_) + F.coalesce("_b", F.lit(0))).withColumn(sum_, F.col(sum_) + F.coalesce("_s", F.lit(0)))
    return part.select(*cols, *stats, F.col(best_).alias("n_best"), F.col(sum_).alias("count_sum"))


def align_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    import public_tokenizers

    out = align_documents(spark, docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN, digest=True)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
