import hashlib
import random
from collections import Counter

import pytest

from hashwood.llm import op10_exact_dedup as X


def brute(rows, length=200):
    raw = [(t or "").encode() for _, t in rows]
    counts = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (key, _), b in zip(rows, raw, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((key, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["alpha", "be", "gämma", "the", "of", "x\0y", "語", ",", "\n"]
    make = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n))
    passages = [make(rng.choice([30, 50, 80, 200])) for _ in range(6)]
    texts = [make(rng.randint(0, 60)) + rng.choice(passages)[rng.randint(0, 60) :] + make(rng.randint(0, 60)) for _ in range(70)]
    base = make(400)
    for _ in range(25):  # near copies
        now = base.split(" ")
        for _ in range(rng.randint(1, 6)):
            now[rng.randrange(len(now))] = "edit" + str(rng.random())
        texts.append(" ".join(now))
    texts += [texts[5]] * 4 + ["a" * 199, "a" * 200, "b" * 201, "ab" * 300, "abc" * 1000 + make(20), "q" * 150 + make(50), "", "short", "short"]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)] + [(None, None), (3, texts[3]), (4, "another " + texts[9]), (None, passages[0])]


@pytest.mark.parametrize("few,shard", [(2000, 2 << 20), (2, 2 << 20), (20, 3000)])
def test_equals_brute_force(spark, monkeypatch, few, shard):
    monkeypatch.setattr(X, "FEW", few)
    monkeypatch.setattr(X, "SHARD_BYTES", shard)
    rows = corpus(few + shard)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_bytes int").repartition(3)
    assert sorted((tuple(r) for r in X.exact_dedup(docs).collect()), key=str) == brute(rows)


def test_text_and_empty(spark):
    rows = [(1, "x" * 10 + "y" * 250 + "end"), (2, None), (3, "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in X.remove_repeats(docs).collect()) == [(1, "x" * 10 + "end"), (2, ""), (3, "é")]
    assert X.exact_dedup(docs.limit(0)).count() == 0


def test_very_long_and_many_rows_of_one_id(spark):
    rng = random.Random(4)
    make = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    long = make(40_000)
    rows = [(1, long + make(50)), (2, make(80) + long[100_000:150_000]), *((7, make(40)) for _ in range(20)), *((7, rows) for rows in [make(60)] * 3), (None, make(60)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in X.exact_dedup(docs).collect()), key=str) == brute(rows)
