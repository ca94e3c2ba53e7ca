"""Byte-level BPE encoding and decoding with DuckDB recursive queries per partition.

Spark splits each text with the tokenizer's pattern.  A task keeps the distinct words it has not
met, turns them into token-position rows and lets a recursive query join them with the merge table:
each step contracts every word's leftmost pair of minimum rank, until no pair can merge.  Ordered
aggregation collects the ids, and an ordered join finds the bytes that they decode to.  A long word (an unbroken
run of letters may be a whole text) keeps one row per position that each step overwrites only where
tokens change, and a step contracts all pairs of that rank from left to right.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spark_rca.llm.common import free_names, keep, lean

#: A vocabulary's own pattern in Java's syntax: its \s is Unicode white space, as in the tokenizer.
SPACE = r"\p{IsWhite_Space}"


def java_pattern(pattern: str) -> str:
    return pattern.replace(r"[^\s", rf"[^{SPACE}").replace(r"\S", rf"[^{SPACE}]").replace(r"\s", SPACE)


def load_ranks(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]


class Encoder:
    """Distinct words to token ids, and ids back to bytes, in one DuckDB connection.

    Remembers words in two generations of at most ``remember``: a word met again in a later batch is
    promoted, so that the many words that occur once don't push out the frequent ones.
    """

    def __init__(self, ranks: list[tuple[bytes, int]], remember: int = 120_000, memory: str = "128MB"):
        import duckdb

        self.remember = remember
        self.often: dict[str, tuple[bytes, bytes]] = {}
        self.recent: dict[str, tuple[bytes, bytes]] = {}
        of = dict(ranks)
        self.whole = {t: (r.to_bytes(4, "little"), t) for t, r in ranks}
        merges = np.array([(of[t[:k]], of[t[k:]], r) for t, r in ranks for k in range(1, len(t)) if t[:k] in of and t[k:] in of], np.int32).reshape(-1, 3)
        self.byte = np.array([of.get(bytes([i]), -1) for i in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": memory})
        self.con.register("merge_rows", pa.table({"l": merges[:, 0], "r": merges[:, 1], "m": merges[:, 2]}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.merges, self.ranks, self.singles = merges, ranks, False
        self.con.register("token_rows", pa.table({"tok": pa.array([r for _, r in ranks], pa.int32()), "bytes": pa.array([t for t, _ in ranks], pa.binary())}))
        self.con.execute("CREATE TABLE tokens AS SELECT * FROM token_rows")

    def find_singles(self) -> None:
        """The table of tokens that may merge again at a lower rank than their own, of which a step contracts one pair only.

        There are none if every token, encoded alone, comes from tokens of lower ranks: so it does in every text then,
        for no merge can cross its bounds before it exists.  Found once, when a long word is met.
        """
        self._register([t for t, _ in self.ranks])
        trained = self.con.sql(TRAINED).fetchall()[0][0]
        self.con.unregister("words")
        late = [self.merges[:, side][self.merges[:, side] > self.merges[:, 2]] for side in (0, 1)]
        self.con.register("single_rows", pa.table({"m": np.unique(np.concatenate(late))[: 0 if trained else None]}))
        self.con.execute("CREATE TABLE singles AS SELECT * FROM single_rows")
        self.singles = True

    def _register(self, words: list[bytes]) -> None:
        size = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        at = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
        self.con.register("words", pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), size), "p": at.astype(np.int32), "tok": self.byte[data], "k": np.zeros(len(data), np.int32)}))

    def contract(self, words: list[bytes], long: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, word after word, and how many each has; ``long`` takes one word."""
        if long and not self.singles:
            self.find_singles()
        self._register(words)
        got = self.con.sql(LONG_FIXPOINT if long else FIXPOINT).to_arrow_table()
        self.con.unregister("words")
        ids = np.concatenate([np.zeros(0, np.uint32), got["ids"].combine_chunks().values.to_numpy().astype(np.uint32)])
        counts = np.diff(got["ids"].combine_chunks().offsets.to_numpy()) if len(got) else np.zeros(0, np.int64)
        return ids, counts

    def encode_words(self, words: list[str], block: int = 320_000, long: int = 400) -> list[tuple[bytes, bytes]]:
        """For each distinct word its little-endian unsigned 32-bit ids and the bytes they decode to.

        Words of over ``long`` bytes are contracted one by one, with the same result.
        """
        if len(self.often) > self.remember:
            self.often = {}
        if len(self.recent) > self.remember:
            self.recent = {}
        often, recent, new = self.often, self.recent, {}
        todo, rows, out = [], 0, {}
        for w in words:
            if w in often:
                continue
            got = recent.pop(w, None) or self.whole.get(b := w.encode())
            if got is not None:
                often[w] = got
                continue
            if len(b) > long:
                self._fill([(w, b)], new, True)
                continue
            todo.append((w, b))
            rows += len(b)
            if rows >= block:
                self._fill(todo, new)
                todo, rows = [], 0
        self._fill(todo, new)
        out = [often[w] if w in often else new[w] for w in words]
        recent.update(new)
        return out

    def _fill(self, todo: list[tuple[str, bytes]], into: dict[str, tuple[bytes, bytes]], long: bool = False) -> None:
        if not todo:
            return
        ids, counts = self.contract([b for _, b in todo], long)
        decoded = self.decode(np.repeat(np.arange(len(todo)), counts), ids)
        raw, at = ids.astype("<u4").tobytes(), 0
        for (w, _), n, d in zip(todo, counts.tolist(), decoded, strict=True):
            into[w] = (raw[at : at + 4 * n], d)
            at += 4 * n

    def decode(self, unit: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """The bytes of each unit (word or text), whose ids follow each other in order, from an ordered join: its column is the bytes one after another."""
        if not len(ids):
            return []
        self.con.register("id_rows", pa.table({"pos": np.arange(len(ids), dtype=np.int64), "tok": ids.astype(np.int32)}))
        got = self.con.sql(DECODE).to_arrow_table()["bytes"].combine_chunks().cast(pa.large_binary())
        self.con.unregister("id_rows")
        _, offs, data = got.buffers()
        offs = np.frombuffer(offs, np.int64)[got.offset : got.offset + len(got) + 1]
        cuts = offs[np.append(np.flatnonzero(np.append(True, unit[1:] != unit[:-1])), len(got))].tolist()
        return [data[a:b].to_pybytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


#: One sort by word and place together, not one for each word.
STEPS = """
WITH RECURSIVE t(w, p, tok, k) AS (
  SELECT w, w::BIGINT << 32 | p, tok, k FROM words
  UNION ALL (
    WITH pair AS (SELECT w, p, tok, lead(tok) OVER o AS next_tok, lead(p) OVER o AS next_p FROM t WINDOW o AS (ORDER BY p)),
    best AS (SELECT w, min(m::BIGINT << 32 | (p & 4294967295)) AS x, arg_min(next_p, m::BIGINT << 32 | (p & 4294967295)) AS gone FROM pair JOIN merges ON tok = l AND next_tok = r WHERE next_p >> 32 = w GROUP BY w)
    SELECT t.w, t.p, CASE WHEN t.p & 4294967295 = x & 4294967295 THEN (x >> 32)::INT ELSE t.tok END, t.k + 1
    FROM t JOIN best USING (w) WHERE t.p <> gone
  )
),
last AS (SELECT w, max(k) AS k FROM t GROUP BY w)"""

FIXPOINT = STEPS + """
SELECT w, list(tok ORDER BY p) AS ids FROM t JOIN last USING (w, k) GROUP BY w ORDER BY w"""

#: Do all words end as one token, of a higher rank than every token merged on the way?
TRAINED = STEPS + """,
done AS (SELECT w, count(*) AS n, max(tok) AS whole FROM t JOIN last USING (w, k) GROUP BY w)
SELECT (SELECT max(n) FROM done) = 1 AND NOT EXISTS (SELECT 1 FROM t JOIN done USING (w) WHERE t.tok > whole AND t.tok NOT IN (SELECT tok FROM words))"""

#: The same contraction for one word, as a linked list: a row is a position, its token (-1: merged away), the next
#: token's position and the rank of the pair of both.  ``hit`` are the pairs of minimum rank; of pairs that overlap in a
#: row of them every other one is contracted.  Only changed rows are returned, so each step overwrites these.
LONG_FIXPOINT = """
WITH RECURSIVE t(p, tok, nxt, m) USING KEY (p) AS (
  SELECT p, tok, nxt, (SELECT m FROM merges WHERE l = tok AND r = next_tok) FROM
    (SELECT p, tok, lead(p) OVER (ORDER BY p) AS nxt, lead(tok) OVER (ORDER BY p) AS next_tok FROM words)
  UNION (
    WITH hit AS (SELECT p, nxt, m FROM recurring.t WHERE m = (SELECT min(m) FROM recurring.t)),
    flagged AS (SELECT *, CASE WHEN lag(nxt) OVER (ORDER BY p) = p THEN 0 ELSE 1 END AS starts FROM hit),
    runs AS (SELECT *, sum(starts) OVER (ORDER BY p) AS run FROM flagged),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY p) AS k FROM runs),
    one AS (SELECT p, nxt AS gone, m FROM numbered WHERE k % 2 = 1 AND (p = (SELECT min(p) FROM hit) OR m NOT IN (SELECT m FROM singles))),
    merged AS (SELECT one.p, one.m AS tok, one.gone, g.nxt FROM one JOIN recurring.t AS g ON g.p = one.gone),
    changed AS (
      SELECT p, tok, nxt FROM merged
      UNION ALL SELECT b.p, b.tok, b.nxt FROM recurring.t AS b JOIN one ON b.nxt = one.p WHERE b.tok >= 0 AND b.p NOT IN (SELECT gone FROM one)),
    following AS (SELECT c.p, c.tok, c.nxt, coalesce(one.m, n.tok) AS next_tok FROM changed c LEFT JOIN one ON one.p = c.nxt LEFT JOIN recurring.t AS n ON n.p = c.nxt)
    SELECT f.p, f.tok, f.nxt, merges.m FROM following f LEFT JOIN merges ON l = f.tok AND r = f.next_tok
    UNION ALL SELECT gone, -1, NULL, NULL FROM one
  )
)
SELECT list(tok ORDER BY p) AS ids FROM t WHERE tok >= 0"""

DECODE = """
SELECT bytes FROM id_rows JOIN tokens USING (tok) ORDER BY pos"""


def _encoder(key: str, ranks: list[tuple[bytes, int]]) -> Encoder:
    """One encoder per Python worker and vocabulary: a worker serves many partitions, and drops it for another operator's."""
    return keep("bpe", key, lambda: Encoder(ranks))


def _joined(pieces: list[bytes], idx: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each list of word numbers its pieces one after another."""
    if not len(idx):
        return [b""] * (len(bounds) - 1)
    _, offs, data = pa.array(pieces, pa.large_binary()).take(pa.array(idx)).buffers()
    at = np.frombuffer(offs, np.int64)[bounds].tolist()
    return [data[x:y].to_pybytes() for x, y in zip(at[:-1], at[1:], strict=True)]


#: What ``encode`` adds.
ADDED = ("n_tokens", "ids", "ids_sha256", "decoded_sha256")


def encode(spark: SparkSession, docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", columns: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` (binary, little-endian unsigned 32 bit), ``ids_sha256`` and ``decoded_sha256``.

    Null texts count as empty: no ids.  Rows are independent, so nothing is shuffled, repeated rows get
    the same and an empty table gives an empty one.  Other columns stay as they are, all or ``columns``; those four are replaced.
    What isn't asked for, the text itself or (not ``with_ids``) the ids, takes no memory of workers.  The rank file
    has a fixed size; it is read by the driver and broadcast.  Code points that Java's tables do not
    know yet are split by the tokenizer's own regex library.
    """
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))
    cols = [c for c in columns or docs.columns if c not in ADDED]
    docs = docs.select(*cols, *[c for c in [text] if c not in cols])
    words_, text_ = free_names(docs, "words", "text")
    body = F.coalesce(F.col(text), F.lit(""))
    odd = body.rlike(r"[\p{Cn}]")
    split = docs.withColumn(words_, F.when(~odd, F.regexp_extract_all(body, F.lit(java_pattern(pattern)), F.lit(0)))).withColumn(text_, F.when(odd, body)).select(*cols, words_, text_)
    schema = StructType([docs.schema[c] for c in cols]).add("n_tokens", "long")
    schema = (schema.add("ids", "binary") if with_ids else schema).add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(it):
        import regex

        own = regex.compile(pattern)
        enc = _encoder(vocabulary, ranks.value)
        for whole in it:
            for a in range(0, whole.num_rows, 500):
                b = pa.Table.from_batches([whole.slice(a, 500)])
                words = b[words_].combine_chunks()
                if words.null_count:
                    lists = words.to_pylist()
                    for i, t in enumerate(b[text_].to_pylist()):
                        if t is not None:
                            lists[i] = own.findall(t)
                    words = pa.array(lists, pa.list_(pa.string()))
                offs = words.offsets.to_numpy()
                coded = pc.dictionary_encode(words.flatten())
                pieces = enc.encode_words(coded.dictionary.to_pylist())
                idx = coded.indices.to_numpy()
                bounds = offs - offs[0]
                out_ids = _joined([x for x, _ in pieces], idx, bounds)
                decoded = _joined([x for _, x in pieces], idx, bounds)
                t = b.select(cols)
                t = t.append_column("n_tokens", pa.array([len(x) // 4 for x in out_ids], pa.int64()))
                t = t.append_column("ids", pa.array(out_ids, pa.binary())) if with_ids else t
                t = t.append_column("ids_sha256", pa.array([hashlib.sha256(x).hexdigest() for x in out_ids], pa.string()))
                t = t.append_column("decoded_sha256", pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()))
                yield from t.to_batches()

    return split.mapInArrow(lean(run, "bpe"), schema)


def bpe_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    out = encode(spark, docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, columns=["doc_id"], with_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
