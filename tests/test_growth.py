"""What must not grow: messages with a tree's height, and what a task holds with its rows."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_pages import PAIRS, built, level, plain
from test_replicas import frame, group, keys

from hashwood.operators import entries as E
from hashwood.operators import fold, pages, reach
from hashwood.streaming import gossip


def batches(rows, size):
    """rows (key, value, level, low, next, said) as the fold's batches."""
    for i in range(0, len(rows), size):
        key, value, lev, low, onward, said = zip(*rows[i : i + size], strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array([0] * len(key), pa.int32()), pa.array(["0"] * len(key)), pa.array(key, pa.int64()), pa.array(value, pa.int64()), pa.array(said, pa.binary()), pa.array(lev, pa.int32()), pa.array(low, pa.string()), pa.array(onward, pa.string())],
            names=["tree", "tree_text", "key", "value", "said", "level", "low", "next"],
        )


@pytest.mark.parametrize(("n", "tasks", "size"), [(1, 1, 1), (700, 1, 1000), (3000, 1, 64), (3000, 7, 50), (3000, 40, 7)])
def test_fold_in_any_parts_equals_recursive_definition(n, tasks, size):
    pairs = [(k, k % 7 if k % 5 else None) for k in range(n)]
    enc = lambda x: b"~" if x is None else f"{len(str(x))}:{x}".encode()
    rows = [(k, v, level(k), None, None, enc(k) + enc(v)) for k, v in pairs]
    found, ends = {}, []
    for t in range(tasks):
        part = rows[t * n // tasks : (t + 1) * n // tasks]
        one, widest = fold.Fold("sha256", False, True), 0
        for made in one.batches(batches(part, size)):
            for r in made.to_pylist():
                widest = max(widest, sum(len(p.rows) for p in one.open))
                if r["hash"]:
                    found[r["hash"]] = r
                else:
                    e = r["entries"][0]
                    ends.append((e["key"], e["value"], r["level"], r["low"], e["next"], r["said"]))
        assert widest < 400  # a page per level, however long the part
    assert len(ends) < 700 or tasks > 7
    for made in fold.Fold("sha256", True, True).batches(batches(sorted(ends, key=lambda e: e[0]), size)):
        found |= {r["hash"]: r for r in made.to_pylist()}
    root, expected = plain(pairs)
    assert {h: (r["level"], r["low"], [(e["key"], e["value"], e["next"]) for e in r["entries"]]) for h, r in found.items()} == expected
    assert [h for h, r in found.items() if r["before_key"] is None and r["until_key"] is None] == [root]


def test_pages_hold_no_partition(spark):
    plan = built(spark, [(k, 1) for k in range(50)])._jdf.queryExecution().toString()
    outline = pages.outline(E.build(spark.createDataFrame([(k, 1) for k in range(50)], "key long, value long"), PAIRS))
    assert "Window" not in plan + outline._jdf.queryExecution().toString()
    assert not hasattr(pages, "bounded")


def test_messages_dont_multiply(spark):
    network, (p1, p2) = group(spark, 2)
    p1.put(frame(spark, range(600)), broadcast=False)
    p1.trigger("p2")
    network.run()
    assert keys(p2) == list(range(600)) and p1.root() == p2.root()
    assert network.delivered <= 8
    p2.put(frame(spark, range(590, 650)), broadcast=False)
    p2.trigger("p1")
    before = network.delivered
    network.run()
    assert keys(p1) == list(range(650)) and p1.root() == p2.root()
    assert network.delivered - before <= 8


def test_get_asks_for_what_is_not_held(spark):
    network, (p1, p2) = group(spark, 2)
    p1.put(frame(spark, range(600)), broadcast=False)
    p2.put(frame(spark, range(580)), broadcast=False)
    shared = {r.hash for r in p2.tree.store.list().collect()} & {r.hash for r in p1.tree.store.list().collect()}
    p1.trigger("p2")
    to, message = network.queue.popleft()
    network.members[to].handle(message)
    to, message = network.queue.popleft()
    assert message.kind == "get"
    network.members[to].handle(message)
    sent = {r.hash for r in next(m for _, m in network.queue if m.kind == "put").pages.collect()}
    assert shared and not sent & shared and p1.root() in sent


def test_walk_reads_only_pages_with_pointers(spark):
    got = built(spark, [(k, 1) for k in range(300)])
    root = pages.roots(got).first().root
    low = {r.hash for r in got.where("level = 0").collect()}
    assert {r.hash for r in reach.reached(got, root).collect()} == {r.hash for r in got.collect()}
    assert {r.hash for r in reach.missing_set(got.where("level > 0"), [root, None]).collect()} == low
    assert {r.hash for r in reach.reached(got, got.select(F.col("hash")).where("level = 0")).collect()} == low


def test_final_state_calls_no_processor(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(gossip, "effective_puts", None)
    rows = [(i % 2, i % 6, [f"e{i % 4}"]) for i in range(60)] + [(0, 99, None)]
    table = spark.createDataFrame(rows, "replica int, key long, value array<string>")
    table.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {(r.replica, r.key): r.value for r in gossip.final_state(gossip.spread(stream(), [0, 1]), "set_union").collect()}
    assert got == {(r, k): sorted({v[0] for _, x, v in rows if x == k and v}) for r in (0, 1) for k in (*range(6), 99)}
