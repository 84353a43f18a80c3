import hashlib
import random

import pytest
from pyspark.sql import functions as F

from hashwood.operators import combine, pages, reach
from hashwood.operators import entries as E
from hashwood.operators.spec import TreeSpec

PAIRS = TreeSpec(("key",), ("value",), "max")


def level(key):
    hexed = hashlib.sha256(str(key).encode()).hexdigest()
    return len(hexed) - len(hexed.lstrip("0"))


def plain(pairs):
    """root and pages {hash: (level, low, [(key, value, next)])} of sorted pairs, by splitting at the highest level."""
    made = {}
    enc = lambda x: "~" if x is None else f"{len(x)}:{x}"

    def build(part):
        if not part:
            return None
        top = max(level(k) for k, _ in part)
        cuts = [i for i, (k, _) in enumerate(part) if level(k) == top]
        low = build(part[: cuts[0]])
        entries = [(*part[i], build(part[i + 1 : j])) for i, j in zip(cuts, [*cuts[1:], len(part)], strict=True)]
        body = f"{top}|{low or '~'}|" + "".join(enc(str(k)) + enc(None if v is None else str(v)) + enc(n) for k, v, n in entries)
        found = hashlib.sha256(body.encode()).hexdigest()
        made[found] = (top, low, entries)
        return found

    return build(sorted(pairs)), made


def built(spark, pairs):
    return pages.pages(E.build(spark.createDataFrame(pairs, "key long, value long"), PAIRS))


@pytest.mark.parametrize("keys", [[5], range(1, 11), range(300), random.Random(2).sample(range(10**6), 700)])
def test_equals_recursive_definition(spark, keys):
    pairs = [(k, k % 7 if k % 5 else None) for k in keys]
    random.Random(3).shuffle(pairs)
    root, made = plain(pairs)
    got = built(spark, pairs)
    assert pages.roots(got).first().root == root
    assert {r.hash: (r.level, r.low, [(e.key, e.value, e.next) for e in r.entries]) for r in got.collect()} == made


def test_strings_and_composite_keys(spark):
    rows = [(f"k{i % 40}", i // 40, i) for i in range(200)]
    source = spark.createDataFrame(rows, "a string, b int, v long")
    spec = TreeSpec(("a", "b"), ("v",), "max")
    found = pages.pages(E.build(source, spec), spec)
    assert pages.roots(found).count() == 1
    walked = [tuple(r.key) for r in pages.page_entries(found).orderBy("key").collect()]
    assert walked == sorted((a, b) for a, b, _ in rows)
    upside = TreeSpec(("a", "b"), ("v",), "max", sort_key="struct(key.b, key.a)")
    other = pages.pages(E.build(source, upside), upside)
    assert pages.roots(other).first().root != pages.roots(found).first().root
    assert pages.fold_pages(other).count() == other.count()


def test_invariants(spark):
    got = built(spark, [(k, 1) for k in range(400)])
    parents = pages.parents(got).collect()
    assert sum(r.slot == "root" for r in parents) == 1 and len({r.child for r in parents}) == len(parents) == got.count()
    order = [r.first_key for r in pages.fold_pages(got).collect()]
    assert order == sorted(order)
    assert pages.fold_pages(got, F.count("*").alias("n")).first().n == got.count()
    refs = pages.refs(got)
    one = got.where("low is not null").first()
    assert got.where(F.col("hash") == one.hash).select(pages.page_refs()).first()[0] == [r.child for r in refs.where(F.col("parent") == one.hash).orderBy("pos").collect()]
    outline = pages.outline(E.build(spark.createDataFrame([(k, 1) for k in range(400)], "key long, value long"), PAIRS))
    assert sorted((r.level, r.first_key) for r in outline.collect()) == sorted((r.level, r.first_key) for r in got.collect())


def test_root_is_a_function_of_contents(spark):
    a, b, z = ([(k, 1) for k in r] for r in (range(1, 1001), range(550, 1501), range(1, 1501)))
    frame = lambda x: E.build(spark.createDataFrame(x, "key long, value long"), PAIRS)
    merged = combine.merge(PAIRS, frame(a), frame(b))
    trees = [t.withColumn("tree", F.lit(i)) for i, t in enumerate((merged, combine.merge(PAIRS, frame(b), frame(a)), frame(z), frame(a), frame(b)))]
    whole = trees[0]
    for t in trees[1:]:
        whole = whole.unionByName(t)
    made = pages.pages(whole, PAIRS)
    roots = {r.tree: r.root for r in pages.roots(made).collect()}
    assert roots[0] == roots[1] == roots[2] and len(set(roots.values())) == 3
    part = lambda i: made.where(F.col("tree") == i)
    keys = lambda df: sorted(r.key for r in df.collect())
    assert keys(combine.diff_pages(part(0), part(3))) == list(range(1001, 1501))
    assert keys(combine.diff_pages(part(0), part(4))) == list(range(1, 550)) and keys(combine.diff_pages(part(3), part(0))) == []
    assert keys(combine.merge_pages(PAIRS, part(3), part(4))) == list(range(1, 1501))
    assert 0 < combine.unshared(part(0), part(3)).count() < part(0).count()


def test_walks(spark):
    got = built(spark, [(k, 1) for k in range(300)])
    root = pages.roots(got).first().root
    assert reach.reachable(got, root).count() == got.count()
    assert reach.missing_set(got, root).count() == 0
    upper = got.where("level > 0")
    missing = {r.hash for r in reach.missing_set(upper, root).collect()}
    assert missing == {r.hash for r in got.where("level = 0").collect()}
    assert [r.hash for r in reach.missing_set(got, "unknown").collect()] == ["unknown"]
    assert reach.entries_at(got, "unknown").count() == 0
    assert sorted(r.key for r in reach.entries_at(got, root).collect()) == list(range(300))
    lines = [r.line for r in pages.dump(got).collect()]
    assert len(lines) == got.count() and sum(not x.startswith(" ") for x in lines) == 1


def test_empty(spark):
    got = built(spark, [])
    assert got.count() == 0 and pages.roots(got).count() == 0 and pages.refs(got).count() == 0
