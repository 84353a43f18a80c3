import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from hashwood.llm import op2_byte_bpe as B

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={})


def test_equals_library():
    rng, lib, coder = random.Random(5), library(), B.coder()
    letters = "abcdeèñüß語тест 　\n\t'0123456789.,!?%$ the ing tion 𝒳\x00"
    batch = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(400)]
    batch += ["a" * 3000, "xyz" * 2000, " " * 900, "", "don't we'll " * 5, "abababab" * 31, "é" * 500]
    ids = coder.encode(batch)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [lib.encode_ordinary(t) for t in batch]
    assert coder.decode(ids) == [t.encode() for t in batch]


def test_long_pieces_in_segments(monkeypatch):
    rng, lib, coder = random.Random(6), library(), B.coder()
    letters = "abcdeinotrs" * 3 + "éß語"
    batch = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 900))) for _ in range(120)]
    batch += [c * n for c in ("a", "ab", "tion", "=", " ", "é") for n in (1, 127, 129, 500, 1001)]
    expected = [lib.encode_ordinary(t) for t in batch]
    for segment in (128, 16, 3):
        monkeypatch.setattr(B, "SEGMENT", segment)
        coder.memo.known.clear()
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(batch)] == expected


def test_long_text_and_unknown_id():
    rng, lib, coder = random.Random(7), library(), B.coder()
    text = " ".join("".join(rng.choice("abcdeinot") for _ in range(rng.randint(1, 9))) for _ in range(200_000))
    ids = coder.encode([text, "x"])
    assert np.frombuffer(ids[0], "<u4").tolist() == lib.encode_ordinary(text) and coder.decode(ids) == [text.encode(), b"x"]
    with pytest.raises(ValueError, match="vocabulary"):
        coder.decode([ids[1], np.array([4_000_000_000], "<u4").tobytes()])


def test_rows(spark):
    rows = [(1, "Hello thé world", 1), (None, None, 2), (2, "", 3), (1, "Hello thé world", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted((tuple(r) for r in B.round_trip(docs).collect()), key=str)
    ids = library().encode_ordinary(rows[0][1])
    assert got[0] == got[1] == (1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(rows[0][1].encode()).hexdigest())
    empty = hashlib.sha256(b"").hexdigest()
    assert got[2:] == [(2, 0, empty, empty), (None, 0, empty, empty)]
    assert B.round_trip(docs.limit(0)).count() == 0
    back = B.decode_ids(B.encode_ids(docs)).collect()
    assert sorted(r.text for r in back) == ["", "", rows[0][1], rows[0][1]]
