import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hashwood.operators import entries as E
from hashwood.operators import pages
from hashwood.operators.spec import TreeError, TreeSpec
from hashwood.operators.tree import MerkleTree
from hashwood.sources import tables
from hashwood.sources.stores import ParquetStore
from hashwood.streaming import gossip

ROOT = Path(__file__).resolve().parents[1]
PAIRS = TreeSpec(("key",), ("value",), "max")
DOWN = TreeSpec(("key",), ("value",), "max", sort_key="-key")


def frame(spark, keys):
    return spark.createDataFrame([(k, k * 3) for k in keys], "key long, value long")


def keys(df):
    return [r.key for r in df.collect()]


@pytest.mark.parametrize("spec", [PAIRS, DOWN])
def test_reads_descend(spark, spec):
    held = MerkleTree(spark, spec)
    with pytest.raises(TreeError):
        held.first()
    held.put(frame(spark, range(0, 600, 2)))
    order = sorted(range(0, 600, 2), reverse=spec is DOWN)
    between = lambda a, b: [k for k in order if (a <= k <= b if spec is PAIRS else a >= k >= b)]
    lo, hi = (101, 150) if spec is PAIRS else (150, 101)
    assert [tuple(r) for r in held.get(44).collect()] == [(44, 132)] and held.get(45).count() == 0
    assert sorted(keys(held.range(lo, hi))) == sorted(between(lo, hi)) and held.range().count() == 300
    assert sorted(keys(held.range(lo))) == sorted(between(lo, 10**6 if spec is PAIRS else -1))
    assert keys(held.first()) == order[:1] and keys(held.last()) == order[-1:]
    assert keys(held.last_n(3)) == order[-3:] and keys(held.last_n(2, 100)) == order[order.index(100) - 2 : order.index(100)]
    assert keys(held.to_list()) == order == keys(held.keys())
    assert held.fold(F.count("*").alias("n"), first=lo, stop=hi).first().n == len(between(lo, hi))
    seen = []
    assert held.foreach(lambda r: seen.append(r.key), first=lo, stop=hi) == len(seen) and seen == between(lo, hi)
    joined = held.fold_ordered(F.lit(""), lambda a, e: F.concat(a, e["key"].cast("string"), F.lit(" ")), first=lo, limit=4).first().result
    assert joined == "".join(f"{k} " for k in [k for k in order if (k >= lo if spec is PAIRS else k <= lo)][:4])
    assert held.multi_get(spark.createDataFrame([(2,), (3,)], "key long")).orderBy("key").collect()[1].value is None


def test_composite_bounds(spark):
    spec = TreeSpec(("a", "b"), ("v",), "max", sort_key="struct(key.b, key.a)")
    rows = [(i % 5, i // 5, i) for i in range(60)]
    held = MerkleTree(spark, spec)
    held.put(spark.createDataFrame(rows, "a int, b int, v long"))
    key = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
    found = [(r.key.a, r.key.b) for r in E.to_list(held.range(key(3, 2), key(1, 4)), spec).collect()]
    assert found == [(a, b) for b, a in sorted((b, a) for a, b, _ in rows) if (2, 3) <= (b, a) <= (4, 1)]


def test_nested_values(spark):
    rows = "VALUES (1, map('b', 2, 'a', 1), array(named_struct('m', map(2, 'y', 1, 'x')))), (2, NULL, NULL)"
    turned = "VALUES (1, map('a', 1, 'b', 2), array(named_struct('m', map(1, 'x', 2, 'y')))), (2, NULL, NULL)"
    for cols in (("m",), ("s",), ("m", "s")):
        spec = TreeSpec(("k",), cols, "lww")
        made = [pages.pages(spec.rows(spark.sql(f"SELECT * FROM {v} AS t(k, m, s)")), spec) for v in (rows, turned)]
        assert pages.roots(made[0]).first().root == pages.roots(made[1]).first().root
        assert len(pages.dump(made[0], spec).collect()) == made[0].count()


def test_collection_deletes_files(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "t"))
    held = MerkleTree(spark, PAIRS, store)
    for part in (range(40), range(40, 60), range(60, 70)):
        held.put(frame(spark, part))
    before = {p.name for p in (tmp_path / "t" / "data").iterdir()}
    other = ParquetStore(spark, str(tmp_path / "t"))
    facts = held.gc(epoch=store.version)
    after = {p.name for p in (tmp_path / "t" / "data").iterdir()}
    named = {d.split("/")[1] for t in store.manifest["tables"].values() for d in t["dirs"]}
    assert facts["freed_count"] > 0 and after == named and before - after and held.range().count() == 70
    with pytest.raises(TreeError, match="another commit"):
        other.set_root(None)
    other.refresh()
    assert MerkleTree(spark, PAIRS, other).root() == held.root()
    (tmp_path / "t" / "manifests" / f"{store.version + 1:012}.json").write_text('{"version": 9, "tab')
    other.refresh()
    assert MerkleTree(spark, PAIRS, other).root() == held.root() and other.version == store.version + 1
    MerkleTree(spark, PAIRS, other).put(frame(spark, [1000]))
    assert ParquetStore(spark, str(tmp_path / "t")).entries().count() == 71


def test_shared_folder_must_be_named(spark):
    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_folder(Session)
    Session.conf = Conf({"spark.master": "local[4]"})
    assert tables.shared_folder(Session) == Session.conf["spark.checkpoint.dir"]


def test_stream_takes_plain_values_only(spark):
    events = spark.createDataFrame([(0, 1, [1])], "replica int, key int, value array<int>")
    with pytest.raises(TreeError, match="merge_stream"):
        gossip.effective_puts(events, "set_union")
    puts = spark.createDataFrame([(0, 1, 5)], "replica int, key int, value int")
    assert sorted(tuple(r) for r in gossip.spread(puts, [0, 1]).collect()) == [(0, 1, 5), (1, 1, 5)]


def test_entry_without_llm_and_with_a_broken_one(tmp_path):
    code = "import __spark_entry__ as e; print(sum(n.startswith('op') for n in e.queries()), len(e.queries()) > 50)"
    for name in ("hashwood", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else subprocess.run(["cp", "-r", ROOT / name, tmp_path / name], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "hashwood" / "llm"], check=True)
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    entry = tmp_path / "__spark_entry__.py"
    text = entry.read_text()
    entry.unlink()
    entry.write_text(text)
    assert run().stdout.split() == ["0", "True"]
    (tmp_path / "hashwood" / "llm").mkdir()
    (tmp_path / "hashwood" / "llm" / "queries.py").write_text("import no_such_module\n")
    assert "no_such_module" in run().stderr
