import numpy as np
import public_tokenizers
import tiktoken

from spark_rca.llm import bpe


def test_words_of_a_block_stay_apart():
    """One sort holds all words of a block: no pair crosses a word, and each word has its own bytes."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(ranks), special_tokens={})
    enc = bpe.Encoder(ranks)
    words = [w for i in range(300) for w in (f"qt{i}h", f"e{i}zth", f" in{i}gé", "日本" * (1 + i % 9) + str(i), "th" * (1 + i % 99) + "q")]
    words = list(dict.fromkeys(words))
    for block in (1, 50, 320_000):
        enc.often, enc.recent = {}, {}
        for w, (ids, raw) in zip(words, enc.encode_words(words, block), strict=True):
            assert raw == w.encode()
            assert ids == b"".join(i.to_bytes(4, "little") for i in ref._encode_single_piece(w))
    assert enc.decode(np.zeros(0, int), np.zeros(0, int)) == []
