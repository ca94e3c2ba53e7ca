"""What docstrings say of empty tables, nulls, equal ids and other columns."""

from collections import Counter

from spark_rca.llm import chat, html_text, simhash

PAGE = "page_id long, url string, html string, text string"
TURN = "conv_id long, turn int, role string, text string, tokens string"


def test_pages(spark):
    html = "<html><body><nav>Menu</nav><article><p>One &amp; two.</p><p>Three</p></article></body></html>"
    pages = spark.createDataFrame([(1, "http://a/1", html, "other"), (1, "http://a/1", html, "other"), (1, "http://a/2", None, None), (2, None, "", None)], PAGE)
    got = html_text.extract_text(pages)
    assert got.columns == ["page_id", "url", "text"]
    want = {(1, "http://a/1", "One & two.\n\nThree"): 2, (1, "http://a/2", ""): 1, (2, None, ""): 1}
    assert Counter(map(tuple, got.collect())) == want
    assert html_text.extract_text(pages.limit(0)).collect() == []


def test_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", None, "x"), (1, 1, None, "yes", "x")], TURN)
    assert chat.place_turns(turns).select("role", "text", "tokens").collect() == [("user", "", 1), ("", "yes", 1)]
    none = turns.limit(0)
    assert chat.place_turns(none).count() == chat.format_conversations(none).count() == chat.read_back(chat.format_conversations(none)).count() == 0


def test_fingerprints(spark):
    prints = spark.createDataFrame([(1, 2), (1, 3), (None, 2), (1, None), (-1, -1)], "hi long, lo long")
    got = simhash.hamming_search(prints, prints).select("q_hi", "q_lo", "hi", "lo", "distance").collect()
    assert sorted(map(tuple, got)) == sorted([(1, 2, 1, 2, 0), (1, 3, 1, 3, 0), (1, 2, 1, 3, 1), (1, 3, 1, 2, 1), (-1, -1, -1, -1, 0)])
    assert simhash.hamming_search(prints.limit(0), prints).count() == simhash.hamming_search(prints, prints.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a b c d", 0)], "doc_id long, text string, fingerprint int")
    rows = {r["doc_id"]: r for r in simhash.fingerprint_query(docs).collect()}
    assert rows[1]["n_chars"] == rows[2]["n_chars"] == 0 and rows[1]["fingerprint"] == rows[2]["fingerprint"] != rows[3]["fingerprint"]
    assert simhash.fingerprint_query(docs.limit(0)).count() == 0
