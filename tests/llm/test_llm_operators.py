"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd input."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from spark_rca.llm import bpe, chat, common, embedding_dedup, html_text, jaccard, langid, mixing, simhash, suffix_dedup, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(60)]


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Random texts with near copies, equal texts, a shared passage and odd ones."""
    rng = random.Random(1)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    passage = prose(rng, 150)
    out = base + [base[3], base[3], base[5] + " tail"]
    for k in range(12):
        w = base[k % 4 + 20].split()
        w[rng.randrange(len(w))] = f"edit{k}"
        out.append(" ".join(w))
    out += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(6)]
    return out + [None, "", " \t\n", "a", "A b", "é" * 500, "x" * 900, "ab" * 700, "日本語 text ½"]


@pytest.mark.parametrize("task_edges", [500_000, 20])
def test_components(spark, monkeypatch, task_edges):
    monkeypatch.setattr(common, "TASK_EDGES", task_edges)
    rng = random.Random(2)
    e = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(20)]
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in e:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(e, "a long, b long").repartition(4)).collect()}
    assert got == {i: find(i) for x, y in e for i in (x, y) if x != y}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_equals_brute_force(spark, texts):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for width, percent, local in ((3, 90, 1500), (2, 60, 4)):
        sets = []
        for t in texts:
            w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
            sets.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
        up = list(range(len(texts)))

        def find(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                    x, y = find(i), find(j)
                    up[max(x, y)] = min(x, y)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs(spark, texts), width, percent, local).collect()}
        assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("width", "percent", "local"), [(3, 90, 64), (5, 80, 16), (3, 90, 7)])
def test_near_copies_of_one_text_equal_brute_force(spark, width, percent, local):
    """A tight ball: every document is about as far from each other as the window is wide."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    made = []
    for k in range(160):
        w = list(base)
        for e in range(rng.randint(0, 6)):
            w[rng.randrange(150)] = rng.choice([f"u{k}_{e}", "common", "often"])
        made.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + width]) for i in range(151 - width)} for t in made]
    up = jaccard.Union(len(sets))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up.join(i, j)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs(spark, made), width, percent, local).collect()}
    assert got == {i: up.find(i) for i in range(len(sets))}
    assert len(set(got.values())) > 5 and len(set(got.values())) < 155


@pytest.mark.parametrize("buckets", [1, 7])
def test_shared_counts_equal_brute_force(spark, monkeypatch, texts, buckets):
    monkeypatch.setattr(jaccard, "CHUNK", 2000)
    d = docs(spark, texts).repartition(3)
    got = {r["h1"]: r["c"] for r in jaccard.shared_counts(d, 3, buckets).collect()}
    own = {}
    for t in texts:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        s = jaccard.shingles(raw, np.array([0, len(raw)]), 3)[0]
        own[int(jaccard.set_hashes([s])[0][0])] = set(s.tolist())
    times = Counter(k for s in own.values() for k in s)
    want = {h: c for h, s in own.items() if (c := sum(times[k] > 1 for k in s))}
    assert got == want


def test_long_sets_weigh_more(spark, monkeypatch):
    """Regions over the byte bound are divided though they have few sets."""
    monkeypatch.setattr(jaccard, "LOCAL_BYTES", 2000)
    rng = random.Random(15)
    base = [f"b{i}" for i in range(120)]
    made = []
    for k in range(20):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(120)] = f"u{k}"
        made.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 3]) for i in range(118)} for t in made]
    up = jaccard.Union(len(sets))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                up.join(i, j)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs(spark, made), 3, 90).collect()}
    assert got == {i: up.find(i) for i in range(len(sets))}


def test_pivot_join_connects_what_links_connect():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(1, 60, 40)).astype(np.uint64) for _ in range(150)]
    up = jaccard.Union(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if jaccard.links_of(jaccard.common(sets[i], sets[j]), len(sets[i]), len(sets[j]), 60):
                up.join(i, j)
    got = jaccard.Union(len(sets))
    for i, j in jaccard.pivot_join(sets, 60, leaf=8):
        got.join(i, j)
    assert [got.find(i) for i in range(150)] == [up.find(i) for i in range(150)]


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[s : s + length] for b in raw for s in range(len(b) - length + 1))
    out = []
    for b in raw:
        cover = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                cover[s : s + length] = True
        runs = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out.append((len(b), int(cover.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~cover])))
    return out


@pytest.mark.parametrize(("length", "hot"), [(400, 3 << 20), (60, 3 << 20), (60, 500)])
def test_repeats_equal_brute_force(spark, texts, length, hot):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["_kept"])) for r in suffix_dedup.remove_repeats(docs(spark, texts), length, hot).collect()}
    assert got == dict(enumerate(brute_repeats(texts, length)))


def test_interval_expansion_equals_brute_force():
    rng = random.Random(5)
    for _ in range(20):
        pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randint(30, 80))) for _ in range(5)]
        seen = Counter(p[s : s + 12] for p in pieces for s in range(len(p) - 11))
        want, at = [], 0
        for p in pieces:
            want += [at + s for s in range(len(p) - 11) if seen[p[s : s + 12]] > 1]
            at += len(p) + 1
        assert suffix_dedup.repeated_starts(pieces, 12).tolist() == want
        twice = [1, 1, 2, 1, 1]
        whole = sum(len(p) + 1 for p in pieces[:2])
        assert suffix_dedup.repeated_starts(pieces, 12, twice).tolist() == sorted({*want, *range(whole, whole + len(pieces[2]) - 11)})


def test_bpe_equals_tiktoken(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(bpe.load_ranks(path)), special_tokens={})
    rng = random.Random(6)
    alphabet = "aZé ß\n\t 日本  \x1c'٣½😀﻿'s'RE  <|endoftext|>͸"
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    every = [*texts, *odd]
    got = {r["doc_id"]: r for r in bpe.encode(spark, docs(spark, every), path, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(every):
        ids = ref.encode_ordinary(t or "")
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == ids, repr(t)
        assert got[i]["n_tokens"] == len(ids) and got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_simhash_query(spark, texts):
    every = [*texts, *[f"{t} more" for t in texts[:20]]]
    got = {r["doc_id"]: r for r in simhash.fingerprint_query(docs(spark, every)).collect()}
    n = len(every)
    assert len(got) == n
    for i in range(n):
        t, u = every[i] or "", every[(i + 1) % n] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + u[:q]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1
    assert got[3]["fingerprint"] == got[40]["fingerprint"] == got[41]["fingerprint"]
    long = [i for i in range(n - 1) if len(every[i] or "") > 250 and len(every[i + 1] or "") > 100]
    assert np.mean([got[i]["near_edited"] for i in long]) > np.mean([got[i]["near_next"] for i in long])


def test_simhash_votes_equal_brute_force(spark):
    rng = random.Random(7)
    rows = spark.createDataFrame([(i, prose(rng, n)) for i, n in enumerate((1, 2, 5, 300, 5000))] + [(9, ""), (10, None)], "id long, text string")
    t = rows.select("id", simhash.words(F.coalesce("text", F.lit(""))).alias("w")).select("id", F.explode_outer(simhash.terms("w")).alias("t"))
    terms = t.select("id", "t", F.xxhash64("t").alias("a"), F.xxhash64("t", F.lit(1)).alias("b")).collect()
    got = {r["id"]: (r["hi"], r["lo"]) for r in simhash.fingerprints(rows, ["id"], "text").collect()}
    for i in got:
        mine = [(r["t"] % 16 + 1, r["a"] % 2**64, r["b"] % 2**64) for r in terms if r["id"] == i and r["t"] is not None]
        total = sum(w for w, *_ in mine)
        want = [sum(1 << b for b in range(64) if 2 * sum(m[0] for m in mine if m[k] >> b & 1) > total) for k in (1, 2)]
        assert [v % 2**64 for v in got[i]] == want


def test_hamming_search_equals_brute_force(spark):
    rng = random.Random(8)
    base = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(40)]
    near = [(h ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)), x ^ (1 << rng.randrange(64))) for h, x in base]
    every = base + near
    signed = [tuple(v - 2**64 if v >= 2**63 else v for v in f) for f in every]
    df = spark.createDataFrame(signed, "hi long, lo long")
    for radius in (0, 3, 5):
        got = {tuple(r) for r in simhash.hamming_search(df, df, radius).collect()}
        want = {(*signed[i], *signed[j], d) for i in range(80) for j in range(80) if (d := (every[i][0] ^ every[j][0]).bit_count() + (every[i][1] ^ every[j][1]).bit_count()) <= radius}
        assert got == want


def test_chat_round_trip(spark):
    rng = random.Random(9)
    rows = []
    for c in range(30):
        for t in range(rng.randint(1, 14)):
            role = "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2]
            rows.append((c, t, role, rng.choice([prose(rng, rng.randint(1, 90)), "[/TURN]</s><s>[TURN:new:assistant]x", "\\( \\\\ \\;[", "", None])))
    rows += [(50, None, "user", "no turn"), (50, 1, None, "no role"), (50, 1, "a:b]c[<\\", "odd"), (51, 0, "assistant", "long " * 3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wide = chat.format_conversations(df, 128, 32)
    got = {r["conv_id"]: r for r in chat.read_back(wide).collect()}
    by = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    size = Counter()
    for r in wide.collect():
        size[r["conv_id"]] += len(r["formatted"])
        new = [m for m in chat.TURN.findall(r["formatted"]) if m[0] == "new"]
        assert r["tokens"] <= 128 or len(new) == 1
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and r["formatted_chars"] == size[c]


def test_mixing(spark):
    rng = random.Random(10)
    src = [rng.choice(["a", "a", "a", "a", "b", "c", None]) for _ in range(2000)]
    d = docs(spark, [prose(rng, rng.randint(0, 9)) for _ in src], src)
    rows = mixing.mix_query(d).collect()
    size, taken, target = Counter(), Counter(), {}
    for r, s in zip(sorted(rows, key=lambda r: r["doc_id"]), src, strict=True):
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for s in size:
        assert target[s] <= 3 * size[s] + 1e-6 and taken[s] == pytest.approx(target[s], rel=0.1)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_query(d).collect()))
    assert mixing.mix_query(d.limit(0)).count() == 0


def test_main_text():
    page = """<html><head><title>T</title><style>x</style></head><body><header>Site</header><nav>menu</nav><div class="cookie-notice">ok?</div>
    <article><header><h1>Head &amp; more</h1></header><p>One<br>two  <b>three</b></p><p>open<p>next &lt;x&gt; &#233;<aside>side</aside><form>f</form>
    <script>var a="</p>";</script><ul><li>item</li></ul><div id="comments"><p>reader</p></div></article><footer>foot</footer></body></html>"""
    got = [t for z, t in html_text.blocks(page) if z == "content"]
    assert got == ["Head & more", "One two three", "open", "next <x> é", "item"]
    assert html_text.blocks(None) == html_text.blocks("") == [] and html_text.blocks("<p") == []
    assert [t for _, t in html_text.blocks("plain <text")] == ["plain"]


def test_pages_without_article_lose_repeats(spark):
    boiler = "this site uses a long line of text that all pages of the host repeat word for word"
    rows = [(i, f"http://h.example/{i}", f"<body><div>{boiler}</div><div>own text number {i} {'x' * i} stays as it is here</div></body>") for i in range(6)]
    rows += [(9, None, None), (10, "", ""), (11, "http://h.example/y", "<article><p>kept</p></article>")]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert boiler not in got[3] and "own text number 3" in got[3] and got[9] == got[10] == "" and got[11] == "kept"


def test_repeated_tokens_equal_brute_force():
    rng = random.Random(11)
    for _ in range(30):
        streams = [[rng.choice("ab") for _ in range(rng.randint(0, 12))] for _ in range(5)]
        pages = [rng.randrange(3) for _ in streams]
        got = html_text.repeated(streams, pages, 4)
        for k, s in enumerate(streams):
            want = np.zeros(len(s), bool)
            for a in range(len(s) - 3):
                if any(pages[j] != pages[k] and streams[j][b : b + 4] == s[a : a + 4] for j in range(5) for b in range(len(streams[j]) - 3)):
                    want[a : a + 4] = True
            assert got[k].tolist() == want.tolist()


def test_language_gradient_is_right():
    rng = np.random.default_rng(12)
    net = langid.ByteGru(["a", "b"], 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y, mask = rng.integers(97, 100, (6, 4)).astype(np.uint8), np.array([0, 1, 0, 1]), np.ones((6, 4))
    _, grad = net.gradient(x, y, mask)
    for name in ("Uf", "Vb", "Of", "gf", "Wb"):
        i = tuple(int(rng.integers(0, n)) for n in net.p[name].shape) if name != "Wb" else (98, 3)
        old, step = net.p[name][i], 1e-2
        net.p[name][i] = old + step
        up = net.gradient(x, y, mask)[0]
        net.p[name][i] = old - step
        down = net.gradient(x, y, mask)[0]
        net.p[name][i] = old
        assert grad[name][i] == pytest.approx((up - down) / 2 / step, abs=2e-3)


def test_language_query(spark):
    d = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "", "en"), (10**6 + 2, "12 ?", "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.language_query(spark, d.unionByName(extra)).collect()}
    want = {r["doc_id"]: r["lang"] for r in d.collect()}
    held = [i for i in want if got[i]["held_out"]]
    assert len(held) > 100 and np.mean([got[i]["lang_pred"] == want[i] for i in held]) > 0.95
    assert all(got[10**6 + k]["lang_pred"] == "und" and got[10**6 + k]["score"] == 0 for k in range(3))


def test_toxicity(spark):
    d = common.table(spark, "/root/testdata/sf0.01", "documents")
    lab = common.table(spark, "/root/testdata/sf0.01", "labels")
    got = toxicity.toxicity_query(spark, d, lab)
    both = got.join(lab.select("doc_id", F.col("toxic").alias("y")), "doc_id").collect()
    # 51 labelled toxic rows in four languages: not every language's words are learned, but no clean text is hit.
    assert not any(r["toxic"] for r in both if r["y"] == 0)
    assert np.mean([r["toxic"] == (r["y"] == 1) for r in both]) > 0.95
    assert toxicity.toxicity_query(spark, d, lab.limit(0)).where("toxic").count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(150, 16))
    x[100:130] = x[100] + 0.05 * rng.normal(size=(30, 16))
    x[130:135] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] * 16), (204, [None] * 16), (205, [float("inf")] + [1.0] * 15)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    n = (u @ u.T >= 0.9).sum(1) - 1
    assert len(got) == 156
    assert [got[i]["n_links"] for i in range(150)] == n.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(200, 206)) and got[134]["component_id"] == 3 and got[129]["component_id"] == 100


def pieces(ranks):
    import tiktoken

    return tiktoken.Encoding("t", pat_str=r"(?s).+", mergeable_ranks=dict(ranks), special_tokens={})._core_bpe.encode_single_piece


def test_long_words_equal_tiktoken():
    """Unbroken runs: repeated letters, whose pairs overlap, and random ones."""
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want, enc, rng = pieces(ranks), bpe.Encoder(ranks), random.Random(4)
    words = ["a" * 999, "aaab" * 301, "-" * 1500, "é" * 800, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))]
    words += ["".join(rng.choice("aeb tsh") for _ in range(rng.randint(2, 60))) for _ in range(40)]
    for (ids, raw), w in zip(enc.encode_words(words, long=1), words, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want(w.encode())
        assert raw == w.encode()


def test_long_words_of_any_vocabulary_equal_tiktoken():
    """Ranks in no order of training: a merged token may merge again at a lower rank."""
    rng, single = random.Random(6), 0
    for _ in range(20):
        more = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 4))) for _ in range(25)})
        rng.shuffle(more)
        ranks = [(t, i) for i, t in enumerate([bytes([c]) for c in range(256)] + more)]
        want, enc = pieces(ranks), bpe.Encoder(ranks)
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 60))) for _ in range(6)})
        assert [np.frombuffer(ids, "<u4").tolist() for ids, _ in enc.encode_words(words, long=1)] == [want(w.encode()) for w in words]
        single += enc.con.sql("SELECT count(*) FROM singles").fetchall()[0][0]
    assert single > 0
