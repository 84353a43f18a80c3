import pytest
from pyspark.sql import functions as F

from hashwood.functions import awset
from hashwood.operators import replicas as R
from hashwood.operators.spec import TreeError, TreeSpec
from hashwood.streaming import gossip

SET = TreeSpec(("key",))


def frame(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "key long")


def group(spark, n=3, spec=SET, **options):
    network = R.LocalNetwork()
    members = [R.Replica(spark, f"p{i}", network.port(f"p{i}"), spec, **options) for i in range(1, n + 1)]
    for m in members:
        network.join(m)
    return network, members


def keys(replica):
    found = replica.tree.entries()
    return [] if found is None else sorted(r.key for r in found.collect())


def test_online(spark):
    network, (p1, p2, p3) = group(spark)
    p1.put(frame(spark, range(1, 11)))
    network.run()
    assert keys(p1) == keys(p2) == keys(p3) == list(range(1, 11))
    p2.put(frame(spark, range(11, 16)))  # at the same time, before any message arrives
    p3.put(frame(spark, range(14, 21)))
    network.run()
    assert keys(p1) == keys(p2) == keys(p3) == list(range(1, 21))
    assert p1.root() == p2.root() == p3.root()
    for p in (p1, p2, p3):
        p.gc()
    pages = [sorted(r.hash for r in p.tree.store.list().collect()) for p in (p1, p2, p3)]
    assert pages[0] == pages[1] == pages[2] == sorted(r.hash for r in p1.tree.pages().collect())


def test_anti_entropy(spark):
    merged = []
    network, (p1, p2) = group(spark, 2, on_merge=lambda me, peer: merged.append((me, peer)))
    p1.put(frame(spark, range(60)), broadcast=False)
    p2.put(frame(spark, range(50, 80)), broadcast=False)
    p1.trigger("p1")
    assert not network.queue
    p1.trigger("p2")
    network.run()
    assert keys(p1) == keys(p2) == list(range(80)) and p1.root() == p2.root()
    assert ("p2", "p1") in merged and p1.merges() == p2.merges() == []
    assert not p1.put(frame(spark, [3])) and not network.queue


def test_empty_peer_and_limits(spark):
    network, (p1, p2) = group(spark, 2, max_merges=1)
    p2.put(frame(spark, range(20)), broadcast=False)
    p1.trigger("p2")  # has nothing; the other offers its tree
    network.run()
    assert keys(p1) == list(range(20))
    p1.waiting = {"p9": "elsewhere"}
    p1.handle(R.Message("gossip", "p2", "another"))
    assert p1.merges() == ["p9"] and not network.queue
    p1.cancel_merge("p9")
    p1.handle(R.Message("gossip", "p2", "another"))
    assert p1.merges() == ["p2"] and network.queue[0][1].kind == "get"
    network.run()  # the peer has no such page
    assert p1.merges() == []
    with pytest.raises(TreeError):
        p1.handle(R.Message("nonsense", "p2"))
    with pytest.raises(TreeError):
        R.Replica(spark, "x", object())


def test_wrong_pages_are_refused(spark):
    _, (p1, p2) = group(spark, 2)
    p2.put(frame(spark, range(20)), broadcast=False)
    p1.waiting = {"p2": p2.root()}
    forged = p2.tree.pages().withColumn("level", F.col("level") + 1)
    with pytest.raises(TreeError, match="hash"):
        p1.handle(R.Message("put", "p2", pages=forged))
    p1.waiting = {}
    p1.handle(R.Message("put", "p2", pages=forged))  # from nobody that was asked
    assert p1.tree.store.list() is None


def test_rounds(spark):
    rows = [(f"r{i}", k, 1) for i in range(5) for k in range(i * 10, i * 10 + 15)]
    spec = TreeSpec(("key",), ("value",), "max")
    now, history = R.anti_entropy(spark.createDataFrame(rows, "replica string, key long, value long"), spec)
    last = history.where(F.col("round") == history.agg(F.max("round")).first()[0]).collect()
    assert len({r.root for r in last}) == 1 and {r.n_entries for r in last} == {55}
    assert history.agg(F.max("round")).first()[0] <= 4 and now.count() == 5 * 55
    whole = R.converged(spark.createDataFrame(rows, "replica string, key long, value long"), spec)
    assert {r.root for r in R.replica_roots(whole, spec).collect()} == {last[0].root}


def test_add_wins_sets_converge(spark):
    spec = TreeSpec(("key",), ("value",), "awset")
    one = lambda elem, actor: frame(spark, range(8)).select("key", awset.single(F.lit(elem), F.lit(actor), F.lit(1)).alias("value"))
    network, (p1, p2) = group(spark, 2, spec)
    p1.put(one("foo", "p1"), broadcast=False)
    p2.put(one("bar", "p2"), broadcast=False)
    p1.trigger("p2")
    network.run()
    for p in (p1, p2):
        assert {tuple(r[0]) for r in p.tree.entries().select(awset.elements(F.col("value"))).collect()} == {("bar", "foo")}
    assert p1.root() == p2.root()


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 3, i % 10, i) for i in range(200)]
    table = spark.createDataFrame(rows, "replica int, key long, value long")
    table.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    expected = sorted(tuple(r) for r in table.groupBy("replica", "key").agg(F.max("value")).collect())
    assert sorted(tuple(r) for r in gossip.final_state(stream(), "max").collect()) == expected
    gossip.merge_stream(stream(), f"{tmp_path}/out", "max").awaitTermination()
    last = spark.read.parquet(f"{tmp_path}/out/snapshot=1")
    assert sorted(tuple(r) for r in last.select("replica", "key", "value").collect()) == expected
