import random

import pytest
from pyspark.sql import functions as F

from hashwood.functions import awset
from hashwood.functions.encoding import digest, level_of
from hashwood.functions.mergers import MERGERS, check_laws
from hashwood.operators import combine
from hashwood.operators import entries as E
from hashwood.operators.spec import TreeError, TreeSpec

PAIRS = TreeSpec(("key",), ("value",), "max")


def tree(spark, pairs, spec=PAIRS):
    return E.build(spark.createDataFrame(pairs, "key long, value long"), spec)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_levels_and_digests(spark):
    import hashlib

    keys = list(range(300))
    got = rows(spark.createDataFrame([(str(k),) for k in keys], "k string").select("k", level_of(F.col("k")), *[digest(F.col("k"), a) for a in ("sha1", "md5", "sha512")]))
    for k, level, *digests in got:
        hexed = hashlib.sha256(k.encode()).hexdigest()
        assert level == len(hexed) - len(hexed.lstrip("0"))
        assert digests == [hashlib.new(a, k.encode()).hexdigest() for a in ("sha1", "md5", "sha512")]


def test_reads(spark):
    t = tree(spark, [(k, k * 10) for k in random.Random(1).sample(range(1, 101), 100)])
    assert rows(E.first(t)) == [(1, 10)] and rows(E.last(t)) == [(100, 1000)]
    assert rows(E.get(t, 7)) == [(7, 70)] and rows(E.get(t, 700)) == []
    assert rows(E.last_n(t, 3)) == [(98, 980), (99, 990), (100, 1000)]
    assert rows(E.last_n(t, 3, 10)) == [(7, 70), (8, 80), (9, 90)]
    assert rows(E.key_range(t, 5, 6).orderBy("key")) == [(5, 50), (6, 60)]
    assert rows(E.to_list(t)) == [(k, k * 10) for k in range(1, 101)]
    assert [k for (k,) in rows(E.keys(t))] == list(range(1, 101))
    assert sorted(rows(E.positions(t))) == [(k, k, k * 10) for k in range(1, 101)]
    wanted = spark.createDataFrame([(3,), (300,)], "key long")
    assert sorted(rows(E.multi_get(t, wanted))) == [(3, 30), (300, None)]


def test_folds(spark):
    t = tree(spark, [(k, k * 10) for k in range(1, 21)])
    assert rows(E.fold(t, F.sum("value"), first=5, stop=10)) == [(450,)]
    assert rows(E.fold(t, F.count("*"), match="value % 20 = 0", keys_only=True)) == [(10,)]
    joined = E.fold_ordered(t, F.lit(""), lambda a, e: F.concat(a, e["key"].cast("string"), F.lit(";")), limit=4)
    assert rows(joined) == [("1;2;3;4;",)]
    seen = []
    assert E.foreach(t, lambda r: seen.append(r.key), stop=3) == 3 and seen == [1, 2, 3]
    assert E.foreach(t, lambda r: None, ordered=False) == 20
    with pytest.raises(TreeError):
        E.select(t, limit=-1)


def test_empty_and_nulls(spark):
    t = tree(spark, [(None, 1), (1, None), (2, 5)])
    assert sorted(rows(t), key=str) == [(1, None), (2, 5)]
    none = t.limit(0)
    assert rows(E.first(none)) == rows(E.last_n(none, 5)) == rows(E.positions(none)) == []


def test_bad_specs(spark):
    with pytest.raises(TreeError):
        TreeSpec(())
    with pytest.raises(TreeError):
        TreeSpec(merger="nonsense")
    with pytest.raises(TreeError):
        TreeSpec(algorithm="crc")
    with pytest.raises(TreeError) as e:
        tree(spark, [(1, 1)], TreeSpec(("missing",)))
    assert e.value.explained()["missing"] == ["missing"]
    maps = spark.createDataFrame([({"a": 1},)], "key map<string,int>")
    with pytest.raises(TreeError):
        TreeSpec().rows(maps)


def test_set_merger_rejects_different_values(spark):
    with pytest.raises(Exception, match="different values"):
        tree(spark, [(1, 1), (1, 2)], TreeSpec(("key",), ("value",), "set")).collect()


def test_merger_laws(spark):
    check_laws(spark, "max", [1, 5, 3], "long")
    check_laws(spark, "min", [1, 5, 3], "long")
    check_laws(spark, "set_union", [["a"], ["b", "a"], []], "array<string>")
    check_laws(spark, "counter_max", [{"x": 1}, {"x": 3, "y": 1}, {"z": 2}], "map<string,long>")
    check_laws(spark, "lww", [(1, "b"), (2, "a"), (1, "c")], "struct<ts:long,v:string>")
    dots = [([("a", "p", 1)], [("p", 1)]), ([], [("p", 1), ("q", 1)]), ([("a", "q", 2), ("b", "p", 2)], [("p", 2), ("q", 2)])]
    check_laws(spark, "awset", dots, awset.DDL)
    with pytest.raises(ValueError, match="idempotent"):
        from hashwood.functions.mergers import Merger

        check_laws(spark, Merger("sum", F.sum), [1, 2], "long")
    assert set(MERGERS) >= {"set", "max", "min", "lww", "set_union", "counter_max", "awset"}


def test_add_wins(spark):
    base = spark.range(1).select(awset.single(F.lit("foo"), F.lit("p1"), F.lit(1)).alias("v"))
    removed = base.select(awset.remove(F.col("v"), F.lit("foo")).alias("v"))
    again = base.select(awset.add(F.col("v"), F.lit("foo"), F.lit("p2")).alias("v"))
    merged = lambda *parts: rows(spark.createDataFrame([tuple(p.first()) for p in parts], f"v {awset.DDL}").agg(awset.elements(awset.merged(F.collect_list("v")))))[0][0]
    assert merged(base, removed) == []
    assert merged(removed, again) == ["foo"]
    two = spark.range(1).select(awset.single(F.lit("bar"), F.lit("p2"), F.lit(1)).alias("v"))
    assert merged(base, two) == ["bar", "foo"] == merged(two, base, two)


def test_merge_and_diff(spark):
    a, b = tree(spark, [(k, 1) for k in range(1, 11)]), tree(spark, [(k, 1) for k in range(5, 16)])
    c = combine.merge(PAIRS, a, b)
    keys = lambda df: sorted(r.key for r in df.collect())
    assert keys(c) == list(range(1, 16)) == keys(combine.merge(PAIRS, b, a))
    assert keys(combine.diff(c, a)) == list(range(11, 16)) and keys(combine.diff(a, c)) == []
    assert keys(combine.diff(a, b)) == [1, 2, 3, 4] and keys(combine.intersect(a, b)) == list(range(5, 11))
    changed = tree(spark, [(k, 2 if k == 3 else None if k == 4 else 1) for k in range(1, 11)])
    assert keys(combine.diff(a, changed)) == [3, 4] and sorted(rows(combine.diff(changed, a)), key=str) == [(3, 2), (4, None)]
    assert rows(E.get(E.put(a, changed, PAIRS), 3)) == [(3, 2)]
