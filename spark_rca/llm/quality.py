"""Quality rules with a suffix array's view of repetition.

A task concatenates the word numbers of some texts and sorts their suffixes by prefix doubling.  Words
are numbered per text and every text ends in a number of its own, so no common prefix crosses texts.
The ranks of each doubling give the longest common prefixes of neighbouring suffixes; an interval
of suffixes that share n words, with neighbours that share fewer and different words before
them, is a maximal repeated substring.  The union of the occurrences of those of at least
``min_words`` words is what a text repeats, and the longest of them is its longest repeat.

Texts are independent: nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from spark_rca.llm.bytehash import SPACE, batches, prefix, span, words
from spark_rca.llm.common import lean

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def ranked(tokens: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks of the first 1, 2, 4, ... tokens of every suffix) of numbers from 0 whose last one is unique in each text.

    Equal ranks at one doubling are equal strings; only suffixes that still tie are sorted again.
    """
    n = len(tokens)
    sa = np.argsort(tokens, kind="stable")
    head = np.ones(n, bool)
    head[1:] = tokens[sa[1:]] != tokens[sa[:-1]]
    rank = np.empty(n, np.int32)
    first = np.flatnonzero(head)
    rank[sa] = np.repeat(first, np.diff(np.append(first, n)))
    levels, depth = [rank], 1
    while len(live := np.flatnonzero(~(head & np.append(head[1:], True)))):
        at = sa[live]
        # A suffix that ties has not met its text's last token yet, so at + depth is inside.
        key = (rank[at].astype(np.int64) << 32) | rank[at + depth]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        sa[live], head[live] = at, new
        rank = rank.copy()
        rank[at] = np.repeat(live[new], np.diff(np.append(np.flatnonzero(new), len(live))))
        levels.append(rank)
        depth *= 2
    return sa, levels


def common_prefixes(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """lcp[i]: tokens that suffixes sa[i - 1] and sa[i] share; lcp[0] is 0."""
    out = np.zeros(len(sa), np.int64)
    i = np.flatnonzero(np.concatenate([[False], levels[0][sa[1:]] == levels[0][sa[:-1]]])) if len(sa) else np.zeros(0, np.int64)
    a, b, got = sa[i - 1], sa[i], np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        # Suffixes that tied before the last doubling end at different tokens: a + got stays inside.
        same = levels[k][a + got] == levels[k][b + got]
        got[same] += 1 << k
    out[i] = got
    return out


def maximal_repeats(tokens: np.ndarray, sa: np.ndarray, lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, length): sa[lo:hi] are the occurrences of each maximal repeated string of ``least`` tokens or more.

    Nearest smaller values on both sides, by pointer jumping, bound the intervals.
    """
    at = np.flatnonzero(lcp >= least)
    if not len(at):
        return at, at, at
    # Runs of neighbouring entries, each between two sentinels of value 0.
    gap = np.concatenate([[1], (np.diff(at) > 1).astype(np.int64)])
    place = np.arange(len(at)) + np.cumsum(gap)
    v = np.zeros(place[-1] + 2, np.int64)
    v[place] = lcp[at]
    left, right = np.arange(len(v)) - 1, np.arange(len(v)) + 1
    for near in (left, right):
        open_ = place
        while len(open_):
            open_ = open_[v[near[open_]] >= v[open_]]
            near[open_] = near[near[open_]]
    lo, hi = at - (place - left[place]), at + (right[place] - place)
    # One entry for each interval; suffixes lo .. hi - 1.
    _, one = np.unique(lo * (len(sa) + 1) + hi, return_index=True)
    lo, hi, length = lo[one], hi[one], lcp[at[one]]
    before = np.where(sa > 0, tokens[sa - 1], -1)
    change = np.cumsum(np.concatenate([[0], before[1:] != before[:-1]]))
    diverse = change[lo] != change[hi - 1]
    return lo[diverse], hi[diverse], length[diverse]


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n places some span start .. start + length - 1 covers."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + lengths, -1)
    return np.cumsum(delta[:-1]) > 0


def _per_text(marks: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks)])
    return total[offs[1:]] - total[offs[:-1]]


#: Columns of ``repetition_rules``, in order, with their types.
BASE = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long"}
METHOD = {"n_repeats": "long", "n_covered_words": "long", "longest_repeat": "long", "base_failed": "boolean", "kept": "boolean"}
ADDED = (*BASE, *METHOD)


def _lines(data: np.ndarray, offs: np.ndarray, p: np.ndarray, ink: np.ndarray) -> np.ndarray:
    """For each text, how many of its lines with a word equal an earlier one."""
    texts = len(offs) - 1
    feed = np.flatnonzero(data == 10)
    # A line ends at each feed and at each text's end.
    ends = np.concatenate([feed, offs[1:]])
    kind = np.concatenate([np.zeros(len(feed), np.int64), np.ones(texts, np.int64)])
    text = np.concatenate([np.searchsorted(offs, feed, "right") - 1, np.arange(texts)])
    order = np.lexsort((kind, ends, text))
    ends, text, kind = ends[order], text[order], kind[order]
    starts = np.concatenate([[0], ends[:-1] + 1])
    fresh = np.concatenate([[True], text[1:] != text[:-1]])
    starts[fresh] = offs[text[fresh]]
    has = np.concatenate([[0], np.cumsum(ink)])
    ok = has[ends] > has[starts]
    text, key = text[ok], span(p, starts[ok], ends[ok])
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    again = (text[1:] == text[:-1]) & (key[1:] == key[:-1])
    return np.bincount(text[1:][again], minlength=texts)


def measure(data: np.ndarray, offs: np.ndarray, least: int) -> dict[str, np.ndarray]:
    """The numbers of BASE, then n_repeats, n_covered_words and longest_repeat, of every text of a byte buffer."""
    texts = len(offs) - 1
    p, ink = prefix(data), ~SPACE[data]
    begins = (data & 0xC0) != 0x80
    starts, ends, at = words(data, offs)
    n = at[1:] - at[:-1]
    out = {"n_words": n, "word_chars": _per_text(ink & begins, offs), "n_symbols": _per_text(SYMBOLS[data], offs), "n_dup_lines": _lines(data, offs, p, ink)}
    # Word numbers, a text's own, and a last one of its own at the end of each text.
    text = np.repeat(np.arange(texts), n)
    key = np.concatenate([span(p, starts, ends), np.arange(texts, dtype=np.uint64)])
    of = np.concatenate([text, np.arange(texts)])
    kind = np.concatenate([np.zeros(len(text), bool), np.ones(texts, bool)])
    order = np.lexsort((key, kind, of))
    a, b = order[1:], order[:-1]
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(np.concatenate([[0], (of[a] != of[b]) | (kind[a] != kind[b]) | (key[a] != key[b])]))
    bounds = at + np.arange(texts + 1)
    tokens = np.empty(len(key), np.int64)
    tokens[np.arange(len(text)) + text] = number[: len(text)]
    tokens[bounds[1:] - 1] = number[len(text) :]
    sa, levels = ranked(tokens)
    lcp = common_prefixes(sa, levels)
    # What each place shares with another one at most; what no maximal repeat covers, no common prefix does:
    # a string that always follows one word is part of the longer string with that word.
    shared = np.empty(len(sa), np.int64)
    shared[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    window = np.flatnonzero(shared >= 3)
    out["n_repeat_words"] = _per_text(covered(len(tokens), window, np.full(len(window), 3)), bounds)
    lo, _, length = maximal_repeats(tokens, sa, lcp, least)
    where = np.searchsorted(bounds, sa[lo], "right") - 1
    out["n_repeats"] = np.bincount(where, minlength=texts)
    longest = np.zeros(texts, np.int64)
    np.maximum.at(longest, where, length)
    repeat = np.flatnonzero(shared >= least)
    out["n_covered_words"] = _per_text(covered(len(tokens), repeat, shared[repeat]), bounds)
    out["longest_repeat"] = longest
    return out


#: Words of a repeat that counts; a text goes if such repeats cover a larger share of its words, or one is longer.
MIN_REPEAT, MAX_COVERED_PERCENT, MAX_REPEAT = 10, 40, 200


def repetition_rules(docs: DataFrame, min_words: int = MIN_REPEAT, max_covered_percent: int = MAX_COVERED_PERCENT, max_repeat: int = MAX_REPEAT, least_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """``docs`` (text, ...) with the numbers of BASE, what its maximal repeats come to, and the verdicts ``base_failed`` and ``kept``.

    base_failed: fewer than ``least_words`` words, or over ``max_repeat_percent`` in a hundred of them in 3-word windows
    that the text holds twice.  kept: not base_failed, maximal repeats of ``min_words`` words or more cover at most
    ``max_covered_percent`` in a hundred words, and the longest has at most ``max_repeat`` words.  Repeats of two
    occurrences that overlap count, and so do the first ones.

    Null and empty texts have zeros everywhere, base_failed and are not kept; repeated rows get the same
    numbers; an empty table gives an empty one.  Other columns stay as they are; those of the added
    names are replaced.  A text is handled whole: a task holds half a megabyte of texts, or one longer text.
    """
    cols = [c for c in docs.columns if c.lower() not in ADDED]
    docs = docs.select(cols)
    schema = StructType([*docs.schema.fields])
    for name, kind in (BASE | METHOD).items():
        schema = schema.add(name, kind)

    def run(it):
        for b in it:
            t = pa.Table.from_batches([b])
            for row, data, offs in batches(t["text"]):
                m = measure(data, offs, min_words)
                n = m["n_words"]
                m["base_failed"] = (n < least_words) | (100 * m["n_repeat_words"] > max_repeat_percent * n)
                m["kept"] = ~m["base_failed"] & (100 * m["n_covered_words"] <= max_covered_percent * n) & (m["longest_repeat"] <= max_repeat)
                part = t.slice(row, len(offs) - 1)
                for name in ADDED:
                    part = part.append_column(name, pa.array(m[name], pa.bool_() if m[name].dtype == bool else pa.int64()))
                yield from part.to_batches()

    return docs.mapInArrow(lean(run), schema)


def keep_unrepetitive(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that ``repetition_rules`` keeps, with their own columns only."""
    judged = repetition_rules(docs, **limits)
    return judged.where("kept").select([c for c in docs.columns if c.lower() not in ADDED])


def quality_query(docs: DataFrame) -> DataFrame:
    """The contract's columns, then n_repeats, n_covered_words and longest_repeat."""
    out = repetition_rules(docs.select("doc_id", "text"))
    return out.select("doc_id", *BASE, "base_failed", "kept", "n_repeats", "n_covered_words", "longest_repeat")
