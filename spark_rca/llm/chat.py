r"""Chat formatting in budgeted windows.

A conversation becomes windows of whole turns.  Prefix sums of turn tokens place each turn; a window
opens with the system turn, repeats the last turns that fit the history budget, then takes new turns
up to the budget.  Only assistant turns that are new in a window carry loss, so every assistant text
is a target exactly once.

Template: ``<s>`` opens a window, each turn is ``[TURN:kind:role]text[/TURN]`` and ``</s>`` closes
it; kind is ``sys``, ``hist`` or ``new``.  Inside roles and texts a backslash becomes ``\\``, ``[``
becomes ``\(`` and ``<`` becomes ``\{``, so no control string, of this template or another, survives in
a text, and ``unescape`` restores it exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURN = re.compile(r"\[TURN:(sys|hist|new):([^\]:]*)\]([^\[<]*)\[/TURN\]")
CODES = {"\\\\": "\\", "\\(": "[", "\\{": "<", "\\)": "]", "\\;": ":"}
#: One conversation that is added to the table by the query: both of its texts hold control strings.
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("[", "\\(").replace("<", "\\{")
    return text.replace("]", "\\)").replace(":", "\\;") if role else text


def unescape(text: str) -> str:
    return re.sub(r"\\.", lambda m: CODES[m[0]], text)


def place_turns(conversations: DataFrame) -> DataFrame:
    """Null-safe turns with ``seq`` and ``tokens`` (words, at least 1), spread and sorted by conversation.

    Turns order by turn (null first), role and text; null roles and texts are empty strings.  The
    text never enters a window buffer: partitions are sorted and then read as a stream, so a
    conversation of any length needs no more memory than one window.  An empty table gives an empty
    one; other columns are dropped.
    """
    t = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("tokens", F.greatest(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long"))
    return t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def windows(rows: Iterable[tuple], budget: int, history: int) -> Iterator[tuple]:
    """(conv_id, window, formatted, tokens) from (conv_id, role, text, tokens) in order.

    ``total`` is the running prefix sum of new-turn tokens; a turn opens a new window when its
    prefix would pass the sum at which the open window ends.  A turn longer than the room stands
    alone.  The system turn is the first turn of a conversation if its role is ``system``.
    """
    conv, number, parts, total, room_end, past, system, used = None, 0, [], 0, 0, deque(), None, 0

    def close():
        return (conv, number, "<s>" + "".join(parts) + "</s>", used)

    def turn(kind, role, text):
        return f"[TURN:{kind}:{escape(role, True)}]{escape(text)}[/TURN]"

    started = False
    for c, role, text, n in rows:
        if not started or c != conv:
            if started:
                yield close()
            started, conv, number, total, past, system, parts, used = True, c, 0, 0, deque(), None, [], 0
            room_end = budget
            if role == "system":
                system = (role, text, n)
                parts, used, room_end = [turn("new", role, text)], n, max(1, budget - n)
                continue
        if total and total + n > room_end:
            yield close()
            number, parts, used = number + 1, [], 0
            if system:
                parts, used = [turn("sys", *system[:2])], system[2]
            shown = [p for p in past]
            parts += [turn("hist", r, x) for r, x, _ in shown]
            used += sum(k for *_, k in shown)
            room_end = total + max(1, budget - used)
        parts.append(turn("new", role, text))
        total, used = total + n, used + n
        past.append((role, text, n))
        while past and sum(k for *_, k in past) > history:
            past.popleft()
    if started:
        yield close()


def format_conversations(conversations: DataFrame, budget: int = 512, history: int = 96) -> DataFrame:
    """(conv_id, window, formatted, tokens), in order within each partition; no row for an empty table."""

    def run(it):
        def rows():
            for b in it:
                yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text", "tokens")), strict=True)

        out, size = [], 0
        for w in windows(rows(), budget, history):
            out.append(w)
            size += len(w[2])
            if size > 1 << 21:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], NAMES)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], NAMES)

    return place_turns(conversations).mapInArrow(run, "conv_id long, window long, formatted string, tokens long")


NAMES, TYPES = ["conv_id", "window", "formatted", "tokens"], [pa.int64(), pa.int64(), pa.string(), pa.int64()]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation from the formatted windows alone; the windows must be in order. No row for an empty table."""

    def run(it):
        conv, got, out = None, None, []

        def done():
            n, turns, chars, loss, size = got
            return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), size)

        def flush(rows):
            cols = zip(*rows, strict=True)
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in it:
            for c, text in zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist(), strict=True):
                if got is None or c != conv:
                    if got is not None:
                        out.append(done())
                    conv, got = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                got[4] += len(text)
                for kind, role, body in TURN.findall(text):
                    if kind != "new":
                        continue
                    role, body = unescape(role), unescape(body)
                    got[0] += 1
                    got[1].update(f"{role}\n{body}\n".encode())
                    if role == "assistant":
                        got[2] += len(body)
                        got[3].update(body.encode())
            if len(out) > 5000:
                yield flush(out)
                out = []
        if got is not None:
            out.append(done())
        if out:
            yield flush(out)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_query(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(conversations.select("conv_id", "turn", "role", "text").unionByName(extra)))
