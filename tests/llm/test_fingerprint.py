import hashlib
import random

import numpy as np
import pytest

from hashwood.llm import op4_fingerprint as P


def plain_ranks(raw):
    out = []
    for i in range(len(raw) - P.WINDOW + 1):
        counts = np.bincount(np.frombuffer(raw[i : i + P.WINDOW], np.uint8), minlength=256)
        entropy = 1000 - int(int(P._TERMS[counts].sum()) * 1000 / (P._MOST * (1 << 20)))
        out.append(P._UNRANKED if entropy < P.LOW or entropy > P.HIGH else 1000 - abs(entropy - P.USUAL))
    return out


def plain_selected(rank):
    width = min(P.POPULAR, len(rank))
    points = [0] * len(rank)
    for i in range(len(rank) - width + 1):
        best = min(range(i, i + width), key=lambda j: (rank[j], j))
        if rank[best] < P._UNRANKED:
            points[best] += 1
    return [i for i, p in enumerate(points) if p >= P.LEAST_POINTS] or list(range(len(rank)))


def make(rng, n):
    return "".join(rng.choice("abcdefg hijklm nopé qrs tuv wxyz.語") for _ in range(n))


def test_ranks_and_selection():
    rng = random.Random(1)
    for n in (0, 10, 63, 64, 65, 130, 1500):
        raw = (make(rng, n) if n != 130 else "a" * 70 + make(rng, 60)).encode()
        rank = P.ranks(np.frombuffer(raw, np.uint8))
        assert rank.tolist() == plain_ranks(raw)
        if len(rank):
            assert P.selected(rank).tolist() == plain_selected(rank.tolist())


def test_likeness():
    rng = random.Random(2)
    a, b = make(rng, 20000), make(rng, 20000)
    one, two = P.Digest.parse(P.fingerprint(a)), P.Digest.parse(P.fingerprint(b))
    assert one.likeness(one) == 1 and one.likeness(two) < 0.1
    half = P.Digest.parse(P.fingerprint(a[:10000] + b[:10000]))
    assert 0.3 < one.likeness(half) < 0.7 and abs(one.likeness(half) - half.likeness(one)) < 0.2
    words = a[:5000] + "changed" + a[5000:]
    assert one.likeness(P.Digest.parse(P.fingerprint(words))) > 0.7
    empty = P.Digest.parse(P.fingerprint(None))
    assert empty.likeness(empty) == 1 and empty.likeness(one) == 0
    assert str(one) == P.fingerprint(a)


def expected(rows):
    ordered = sorted(((k, t or "") for k, t in rows), key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1]))
    out = []
    for i, (k, t) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        cut = len(t) // 2
        edit = t[: len(t) - cut] + after[:cut]
        digest = lambda x: P.Digest.parse(P.fingerprint(x))
        out.append((k, len(t), hashlib.sha256(edit.encode()).hexdigest(), P.fingerprint(t), P.fingerprint(edit), digest(t).likeness(digest(edit)), digest(t).likeness(digest(after))))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1, 7, 90])
def test_rows(spark, size):
    rng = random.Random(size)
    rows = [(rng.randint(-5, 500), make(rng, rng.choice([0, 1, 30, 64, 100, 700, 3000]))) for _ in range(size)]
    if size > 1:
        rows += [(None, make(rng, 200)), (None, None), (3, None), (3, "x" * 500), rows[0], (10**17, "end" * 100)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_chars int").repartition(3)
    got = sorted((tuple(r) for r in P.fingerprints(docs).collect()), key=str)
    assert got == expected(rows)
    assert P.fingerprints(docs.limit(0)).count() == 0
