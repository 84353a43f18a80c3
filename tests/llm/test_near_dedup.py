import random
import re

import numpy as np
import pytest

from hashwood.llm import op8_near_dedup as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text, size):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, size, num, den):
    sets = [plain_set(t, size) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), k), k) if k is not None else k
    return [(k, len(sets[i]), least[root(i)], k == least[root(i)]) for i, (k, _) in enumerate(rows)]


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "The"]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [" ".join(make(rng.choice([1, 2, 3, 4, 6, 20, 60, 300]))) for _ in range(60)]
    for length, copies in ((200, 40), (30, 20), (8, 15), (900, 10)):
        now = make(length)
        for _ in range(copies):  # a chain: each is edited from the last or from the first
            now = list(now)
            for _ in range(rng.randint(0, max(1, length // 60))):
                now[rng.randrange(length)] = rng.choice(vocabulary)
            texts.append(" ".join(now))
    texts += [texts[3]] * 30 + [texts[70].upper(), texts[70].replace(" ", "\n ")]
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    return rows + [(1000, None), (1001, ""), (1002, " \t\n"), (None, texts[0]), (None, None)]


@pytest.mark.parametrize("small", [True, False])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(N, "BLOCK_SKETCHES", 7)
        monkeypatch.setattr(N, "BLOCK_SHINGLES", 700)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string").repartition(4)
    for size, num, den in ((3, 85, 100), (5, 80, 100)):
        got = sorted((tuple(r)[:4] for r in N.near_duplicates(docs, size, num, den).collect()), key=str)
        assert got == sorted(brute(rows, size, num, den), key=str)


def test_repeated_ids_and_empty(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(5, text), (5, text), (7, text), (7, "other words are here in this one")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in N.near_duplicates(docs).collect())
    assert got == [(5, 5, True), (5, 5, True), (7, 5, False), (7, 7, True)]
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_estimate():
    rng = np.random.default_rng(2)
    for n in (5, 50, 300, 5000):
        pool = rng.integers(0, 2**64, 2 * n, np.uint64)
        share = 0.8
        common = int(2 * n * share / (1 + share))
        guesses = []
        for _ in range(10):
            pool = rng.permutation(rng.integers(0, 2**64, 2 * n - common, np.uint64))
            a, b = np.unique(pool[:n]), np.unique(pool[n - common :])
            guesses.append(N.estimate(N.sketch(a), N.sketch(b)) - common / (2 * n - common))
        assert abs(np.mean(guesses)) < 0.08


def test_texts_of_one_id_are_told_apart(spark):
    base = [f"v{i}" for i in range(100)]
    near = [*base[:98], "x", "y"]
    other = [f"z{i}" for i in range(100)]
    rows = [(5, " ".join(base)), (5, " ".join(other)), (9, " ".join(near)), (5, " ".join(near)), (8, " ".join([*other[:99], "q"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r)[:4] for r in N.near_duplicates(docs).collect())
    assert got == sorted(brute(rows, 5, 80, 100))
    assert sorted(r.doc_id for r in N.keep_one(docs).collect()) == [5, 5]


def test_very_long_texts(spark):
    rng = random.Random(3)
    long = [f"w{rng.randrange(30_000)}" for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[:55_000], *("new" + w for w in long[55_000:])])), (3, " ".join(long[:30_000]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in N.near_duplicates(docs).collect()) == sorted(brute(rows, 5, 80, 100))


def test_keep_one_keeps_every_column(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text, 1, 2, "a", True), (1, text, 1, 2, "a", True), (2, text, 3, 4, "b", False), (3, "quite another text of some words", 5, 6, "c", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hash long, _id long, text_hash string, stays boolean")
    got = sorted(N.keep_one(docs).collect())
    assert [tuple(r) for r in got] == [rows[0], rows[3]] and N.keep_one(docs).columns == docs.columns
