import zlib

import numpy as np
from tokenizers import Tokenizer

from corpusloom.llm import packing


def test_pieces_against_the_tokenizer(docs, texts):
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert 0 < r.length <= 1024 and len(r.ids) == 4 * r.length
    for i, text in enumerate(texts):
        want = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: (r.start, r.sequence_id))[:: 2 if i == 0 else 1]
        assert b"".join(bytes(p.ids) for p in pieces) == want.tobytes()
        assert all(p.doc_tokens == len(want) for p in pieces)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert zlib.crc32(b"") == 0


def test_added_tokens_within_texts():
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.load_encoder(None)
    draw = np.random.default_rng(6)
    parts = ["<|endoftext|>", "<|endoftext|", "|endoftext|>", "<|", " ", "  ", "\n", "a", "the end", "don't", "12", "é", "<", ">"]
    for _ in range(3000):
        text = "".join(draw.choice(parts, draw.integers(1, 9)))
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    assert 50256 in encode("a<|endoftext|>b").tolist()


def test_best_fit_takes_the_tightest_window():
    lengths = [600, 500, 400, 300, 200, 24]
    where, offset, opened = packing.best_fit_decreasing(lengths, 1024)
    assert opened == 2 and where[2] == where[0] and where[3] == where[4] == where[1]
    assert offset == [0, 0, 600, 500, 800, 1000]


def test_best_fit_against_a_linear_search():
    draw = np.random.default_rng(3)
    lengths = draw.integers(1, 1024, 500).tolist()
    where, _, opened = packing.best_fit_decreasing(lengths, 1024)
    free = []
    for i in sorted(range(500), key=lambda i: (-lengths[i], i)):
        fits = [f for f in free if f >= lengths[i]]
        if fits:
            free[free.index(min(fits))] -= lengths[i]
        else:
            free.append(1024 - lengths[i])
    assert opened == len(free)
    assert sorted(np.bincount(where, weights=lengths).astype(int)) == sorted(1024 - f for f in free)


def test_empty_table_and_sequences(nothing, docs):
    assert packing.pack(nothing).count() == 0
    joined = packing.sequences(packing.pack(docs)).collect()
    assert all(len(r.ids) == 4 * r.length for r in joined)
