import cProfile
import random
from collections import Counter

import pyarrow as pa

from spark_rca.llm import suffix_dedup


def block(bodies, base=3):
    n = len(bodies)
    return pa.RecordBatch.from_pydict({"g": [0] * n, "gram": [5] * n, "frag": list(range(n)), "body": bodies, "base": pa.array([base] * n, pa.int64()), "c": [1] * n})


def test_python_calls_of_a_block_do_not_grow_with_its_fragments():
    r = random.Random(4)
    shared = r.randbytes(60)
    calls = []
    for n in (200, 800):
        bodies = [r.randbytes(9) + shared + r.randbytes(9) for _ in range(n)]
        profile = cProfile.Profile()
        got = profile.runcall(suffix_dedup.solved, [block(bodies)], 50, 1)
        assert sorted(x["frag"] for x in got.to_pylist()) == list(range(n)) and all(x["gram"] == 5 and 9 < x["s"] <= 12 and 72 <= x["e"] < 75 for x in got.to_pylist())
        calls.append(sum(x.callcount for x in profile.getstats()))
    assert calls[1] - calls[0] < 2 * 600  # two calls of len for each


def test_bytes_of_any_length_equal_brute_force():
    """Strings shorter than a first key, few or all byte values, and pieces that end alike."""
    r = random.Random(6)
    for length in (1, 2, 3, 6, 7, 20):
        for values in (1, 2, 256):
            base = bytes(r.randrange(values) for _ in range(90))
            pieces = [base[r.randrange(30) : r.randrange(60, 90)] for _ in range(4)] + [base[-40:], b"x" + base[-40:]]
            seen = Counter(p[s : s + length] for p in pieces for s in range(len(p) - length + 1))
            want, at = [], 0
            for p in pieces:
                want += [at + s for s in range(len(p) - length + 1) if seen[p[s : s + length]] > 1]
                at += len(p) + 1
            assert suffix_dedup.repeated_starts(pieces, length).tolist() == want


def test_a_block_without_repeats_gives_no_span():
    assert suffix_dedup.solved([block([b"abcdefghij", b"klmnopqrst"])], 8, 1).num_rows == 0
