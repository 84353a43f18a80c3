import pytest
from pyspark.sql import functions as F

from hashwood.operators.spec import TreeError, TreeSpec
from hashwood.operators.tree import MerkleTree
from hashwood.sources.stores import MemoryStore, ParquetStore, SnapshotStore

SET = TreeSpec(("key",))


def frame(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "key long")


def keys(df):
    return sorted(r.key for r in df.collect()) if df is not None else []


@pytest.fixture(params=["memory", "snapshot", "parquet"])
def store(request, spark, tmp_path):
    return {"memory": lambda: MemoryStore(spark), "snapshot": lambda: SnapshotStore(spark), "parquet": lambda: ParquetStore(spark, f"file://{tmp_path}/tree")}[request.param]()


def test_versions_and_collection(spark, store):
    spans = []
    tree = MerkleTree(spark, SET, store, on_span=lambda name, facts: spans.append((name, facts)))
    assert tree.root() is None and tree.entries() is None and tree.dump() == ""
    roots = []
    for k in (1, 2, 3):
        assert tree.put(frame(spark, [k]))
        roots.append(tree.root())
    assert not tree.put(frame(spark, [2])) and tree.root() == roots[2]
    assert keys(tree.entries()) == [1, 2, 3] and store.version == 3
    if store.persistent:
        assert [keys(tree.entries(r)) for r in roots] == [[1], [1, 2], [1, 2, 3]]
        assert {r.referenced for r in store.is_referenced_at(3).collect()} == {True, False}
        facts = tree.gc(epoch=2)
        assert facts["freed_count"] > 0 and keys(tree.entries(roots[0])) == [] and keys(tree.entries(roots[1])) == [1, 2]
        tree.gc(epoch=3)
        assert keys(tree.entries(roots[1])) == [] and keys(tree.entries(roots[2])) == [1, 2, 3]
    else:
        assert keys(tree.entries(roots[0])) == []
    before = tree.gc()
    assert before["freed_count"] == 0 and spans[-1][0] == "gc"
    assert "3=true" in tree.dump()
    tree.view("tree_rows")
    assert spark.sql("select count(*) from tree_rows").first()[0] == 3


def test_contract(spark, store):
    tree = MerkleTree(spark, SET, store)
    tree.put(frame(spark, range(40)))
    root = tree.root()
    assert store.get(root).count() == 1 and store.has([root, "x"]).collect()[0].hash == root
    assert store.list_root(root).count() == store.list().count()
    assert store.page_refs("x") == [] and len(store.page_refs(root)) > 0
    child = store.page_refs(root)[0]
    other = SnapshotStore(spark)
    other.copy(store, root)
    assert other.list().count() == store.list().count() and other.missing_set(root).count() == 0
    other.put(other.list())
    assert other.list().count() == store.list().count()
    other.delete_page(child)
    assert [r.hash for r in other.missing_set(root).collect()] == [child]
    assert [r.hash for r in MemoryStore(spark).missing_set(root).collect()] == [root]
    with pytest.raises(TreeError):
        store.set_root(5)
    with pytest.raises(TreeError):
        store.gc()
    store.free([root])
    assert store.get_root() is None
    store.delete()
    assert store.list() is None and store.get_root() is None


def test_transaction_is_all_or_nothing(spark, store):
    tree = MerkleTree(spark, SET, store)
    tree.put(frame(spark, [1, 2]))
    root, version = tree.root(), store.version
    with pytest.raises(RuntimeError), store.transaction():
        store.set_root(None)
        with store.transaction():
            store.delete_page(root)
        assert store.get_root() is None
        raise RuntimeError
    assert store.get_root() == root and store.version == version and keys(tree.entries()) == [1, 2]


def test_merge_and_diff_of_trees(spark):
    a, b = MerkleTree(spark, SET), MerkleTree(spark, SET, SnapshotStore(spark))
    a.put(frame(spark, range(1, 11)))
    b.put(frame(spark, range(5, 16)))
    assert keys(a.diff(b)) == [1, 2, 3, 4] and keys(b.diff(a)) == list(range(11, 16))
    roots = a.root(), b.root()
    assert a.merge(b) and keys(a.entries()) == list(range(1, 16)) and b.root() == roots[1]
    assert b.merge(a) and b.root() == a.root() and not b.merge(a)
    empty = MerkleTree(spark, SET)
    assert empty.merge(a) and empty.root() == a.root() and not a.merge(MerkleTree(spark, SET))
    assert keys(a.diff(MerkleTree(spark, SET))) == list(range(1, 16))


def test_parquet_survives_and_detects_conflicts(spark, tmp_path):
    path = f"file://{tmp_path}/tree"
    tree = MerkleTree(spark, SET, ParquetStore(spark, path))
    tree.put(frame(spark, [1, 2, 3]))
    other = ParquetStore(spark, path)
    assert other.get_root() == tree.root() and keys(MerkleTree(spark, SET, other).entries()) == [1, 2, 3]
    tree.put(frame(spark, [4]))
    with pytest.raises(TreeError, match="another commit"):
        other.set_root(None)
    other.refresh()
    assert other.get_root() == tree.root()
    assert keys(MerkleTree(spark, SET, other).entries()) == [1, 2, 3, 4]
    with pytest.raises(TreeError):
        ParquetStore(spark, "")
    assert F is not None
