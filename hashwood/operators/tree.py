"""A tree over a store: puts, merges and reads with versions, and a span per merge and collection."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stores import MemoryStore, Store
from ..sources.tables import written
from . import combine
from . import entries as reads
from .pages import dump, page_entries, pages, roots
from .reach import entries_between
from .spec import TreeError, TreeSpec


class MerkleTree:
    """Entries as pages in a store; every commit is one version and frees the pages that its root no longer reaches."""

    def __init__(self, spark: SparkSession, spec: TreeSpec = TreeSpec(), store: Store | None = None, on_span: Callable[[str, dict], None] | None = None):
        if store is not None and not isinstance(store, Store):
            raise TreeError("that is no store", store=type(store).__name__)
        self.spark, self.spec, self.store = spark, spec, store or MemoryStore(spark)
        self.on_span = on_span or (lambda name, facts: None)
        #: The current root's pages, and the root and version of the store that they are of; saves a walk.
        self.held: tuple[str, int, DataFrame] | None = None

    def _span(self, name: str, began: float, **facts) -> None:
        self.on_span(name, {"seconds": time.time() - began, **facts})

    def root(self) -> str | None:
        return self.store.get_root()

    def entries(self, root: str | None = None) -> DataFrame | None:
        """(key, value) under a root; None before the first put."""
        now = self._current() if root is None else None
        return self.store.entries(root) if now is None else page_entries(now).select("key", "value")

    def _current(self) -> DataFrame | None:
        """The current root's pages, if the store wasn't changed but through this tree."""
        return self.held[2] if self.held and self.held[:2] == (self.root(), self.store.version) else None

    def _there(self) -> DataFrame:
        found = self.store.list()
        if found is None or self.root() is None:
            raise TreeError("the tree is empty")
        return found

    # Reads of the current root. Those by key descend: a round per level, over the pages that lead there.
    def get(self, key) -> DataFrame:
        """The entry of a key (a value, or a column for a composite one), or no row."""
        return self.range(key, key)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        self._there()
        return reads.multi_get(self.entries(), keys)

    def range(self, lo=None, hi=None) -> DataFrame:
        """Entries between two keys, both included."""
        return entries_between(self._there(), self.root(), self.spec, lo, hi)

    def _end(self, last: bool) -> DataFrame:
        """The entry at an end: one page per level, followed on the driver."""
        there, now = self._there(), self.root()
        while True:
            page = there.where(F.col("hash") == now).limit(1)
            onward = page.select(F.expr("element_at(entries, -1).next") if last else F.col("low")).first()[0]
            if onward is None:
                return page.select(F.expr(f"element_at(entries, {-1 if last else 1})").alias("e")).select("e.key", "e.value")
            now = onward

    def first(self) -> DataFrame:
        return self._end(False)

    def last(self) -> DataFrame:
        return self._end(True)

    def last_n(self, n: int, below=None) -> DataFrame:
        return reads.last_n(self.range(None, below), n, below, self.spec)

    def to_list(self) -> DataFrame:
        return reads.to_list(self.range(), self.spec)

    def keys(self) -> DataFrame:
        return reads.keys(self.range(), self.spec)

    def fold(self, *aggregates, **options) -> DataFrame:
        return reads.fold(self.range(options.get("first"), options.get("stop")), *aggregates, spec=self.spec, **options)

    def fold_ordered(self, zero, step, **options) -> DataFrame:
        return reads.fold_ordered(self.range(options.get("first"), options.get("stop")), zero, step, spec=self.spec, **options)

    def foreach(self, function: Callable, ordered: bool = True, **options) -> int:
        return reads.foreach(self.range(options.get("first"), options.get("stop")), function, ordered, spec=self.spec, **options)

    def pages(self) -> DataFrame | None:
        now, held = self.root(), self._current()
        return held if held is not None or now is None else self.store.list_root(now)

    def _commit(self, whole: DataFrame) -> str | None:
        """Makes whole the tree's contents; the new root."""
        old, built = self.root(), pages(whole, self.spec)
        found = roots(built).first()
        new = found and found.root
        if new != old:
            before = self.pages()
            with self.store.transaction():
                self.store.put(built, unique=True)
                self.store.set_root(new)
                if before is not None:
                    self.store.free(before.select("hash").join(built.select("hash").hint("merge"), "hash", "left_anti"))
            self._hold(built)
        return new

    def _hold(self, built: DataFrame) -> None:
        now = self.root()
        self.held = now and (now, self.store.version, built.select("hash", "level", "low", "entries"))

    def adopt(self, root: str, built: DataFrame) -> None:
        """Makes a root whose pages are all there that of an empty tree: what a merge with nothing comes to."""
        if self.root() is not None:
            raise TreeError("only an empty tree can adopt a root", root=self.root())
        self.store.set_root(root)
        self._hold(built)

    def put(self, source: DataFrame) -> bool:
        """Puts all rows of a source; whether the root changed."""
        old, rows, now = self.root(), self.spec.rows(source), self.entries()
        whole = rows if now is None else now.unionByName(rows)
        return self._commit(reads.merge_values(whole, self.spec.merger, "key")) != old

    def merge(self, other: MerkleTree, root: str | None = None, theirs: DataFrame | None = None) -> bool:
        """Takes over another tree, or any root of it, whose pages may be given; whether the root changed."""
        began, old = time.time(), self.root()
        root = root or other.root()
        changed = False
        if root is not None and root != old:
            theirs, ours = theirs if theirs is not None else other.store.list_root(root), self.pages()
            if theirs is not None:
                whole = combine.merge(self.spec, page_entries(theirs)) if ours is None else combine.merge_pages(self.spec, ours, theirs)
                changed = self._commit(written(whole, "merged")) != old
        self._span("merge", began, changed=changed)
        return changed

    def diff(self, other: MerkleTree) -> DataFrame | None:
        """Entries here whose key the other lacks or has with another value. Changes nothing in either."""
        ours, theirs = self.pages(), other.pages()
        if ours is None or theirs is None:
            return None if ours is None else self.entries()
        return combine.diff_pages(ours, theirs)

    def put_pages(self, built: DataFrame) -> None:
        """Adds raw pages; the root stays."""
        now = self._current()
        self.store.put(built)
        if now is not None:
            self._hold(now)

    def missing_set(self, root: str) -> DataFrame:
        return self.store.missing_set(root)

    def gc(self, keep: list[str] | None = None, epoch: int | None = None) -> dict[str, int]:
        """Drops what neither the current root nor the kept ones reach, or what an epoch allows."""
        began = time.time()
        facts = self.store.gc(epoch=epoch) if epoch is not None else self.store.gc(keep=[r for r in (keep if keep is not None else [self.root()]) if r])
        self._span("gc", began, **facts)
        return facts

    def dump(self) -> str:
        """The tree as indented lines; for trees that one can read."""
        built = self.pages()
        return "" if built is None else "\n".join(r.line for r in dump(built.withColumns({"tree": F.lit(0), "first_key": F.expr("entries[0].key"), "low_of": F.lit(None), "after_key": F.when(F.col("hash") != self.root(), F.expr("entries[0].key"))}), self.spec).toLocalIterator())

    def view(self, name: str) -> None:
        """Registers the entries for SQL."""
        found = self.entries()
        if found is None:
            raise TreeError("the tree is empty")
        found.createOrReplaceTempView(name)

    def delete(self) -> None:
        self.store.delete()
