import hashlib
import random
import re

import pytest

from hashwood.llm import op9_decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(doc, items, window=10):
    words, hit, found = split(doc), set(), set()
    for key, text in items:
        item = split(text)
        for i in range(max(1, len(item) - window + 1) if item else 0):
            w = item[i : i + window]
            for j in range(len(words) - len(w) + 1):
                if words[j : j + len(w)] == w:
                    hit |= {*range(j, j + len(w))}
                    found.add("null" if key is None else str(key))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def cases():
    rng = random.Random(3)
    vocabulary = ["the", "Of", "É", "a1", "x", "zz-y"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, make(rng.choice([3, 8, 10, 12, 40, 60]))) for i in range(25)] + [(None, make(20)), (90, None), (91, ". ,"), (3, make(15)), (92, "the " * 14)]
    docs = [(i, make(rng.randint(0, 12)) + rng.choice([" ", ", "]) + rng.choice(items[:25])[1][rng.randint(0, 9) :] + rng.choice(["", " other "]) + make(rng.randint(0, 40))) for i in range(120)]
    docs += [(200, None), (201, ""), (None, items[0][1]), (5, docs[5][1]), (202, "the " * 300), (203, "no benchmark words at all here " * 3)]
    return docs, items


@pytest.mark.parametrize("limit", [1 << 24, 900])
def test_equals_brute_force(spark, limit):
    rows, items = cases()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_hit int").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r)[:6] for r in D.scan(docs, benchmark, limit).collect()), key=str)
    assert got == sorted(((k, *brute(t, items)) for k, t in rows), key=str)
    clean = D.decontaminate(docs, benchmark, limit)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((k for k, t in rows if not brute(t, items)[4]), key=str)


def longest(doc, items, window=10):
    words, most = split(doc), 0
    for item in (split(text) for _, text in items):
        for i in range(len(item)):
            for j in range(len(words)):
                n = 0
                while i + n < len(item) and j + n < len(words) and item[i + n] == words[j + n]:
                    n += 1
                most = max(most, n if n >= min(window, len(item)) else 0)
    return most


@pytest.mark.parametrize("limit", [1 << 24, 900])
def test_longest_match_is_within_one_item(spark, limit):
    rows, items = cases()
    long = [t for _, t in items if len(split(t)) >= 40]
    rows = rows[::6] + [(300, " ".join(split(long[0])[-12:] + split(long[1])[:15])), (301, " ".join(split(long[0])[3:30] + split(long[0])[20:35])), (302, " ".join([long[0], "other", long[1]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.longest_match) for r in D.scan(docs, spark.createDataFrame(items, "item_id long, text string"), limit).collect()), key=str)
    assert got == sorted(((k, longest(t, items)) for k, t in rows), key=str)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert tuple(D.scan(docs, none).first())[:4] == (1, 2, 0, 0)
    assert D.scan(docs.limit(0), none).count() == 0
    assert D.decontaminate(docs, none).count() == 1


def test_suffixes_sorted():
    import numpy as np

    rng = np.random.default_rng(4)
    ids = rng.integers(0, 4, 500)
    order, left = D.suffix_array(ids, 2)
    keys = [ids[p : p + left[p]].tolist() for p in order]
    assert keys == sorted(keys) and len(keys) == (left >= 2).sum()
