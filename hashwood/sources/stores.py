"""Page stores: where trees keep their pages, roots and freed marks.

All have one contract. Pages are content-addressed, so putting one twice changes nothing. Versions are numbers of
commits; they serve as epochs. A page that a commit frees stays until a collection of an epoch that isn't before its
mark, so earlier roots can be read meanwhile. Marks are kept apart from pages and never travel with them.

MemoryStore drops freed pages at once; SnapshotStore keeps them; ParquetStore keeps them in a directory in which a
commit's files appear together, with the one manifest of its version, and a collection deletes the files that only
earlier manifests name.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.pages import page_refs
from ..operators.reach import as_hashes, entries_at, missing_set, reachable
from ..operators.spec import TreeError
from .tables import delete, exists, hadoop_path, written

COLUMNS = ("hash", "level", "low", "entries")
FREED, ROOTS = "hash string, freed_at long", "version long, root string"


class Store:
    """Pages, roots and freed marks of one tree, as tables that a commit replaces or adds to."""

    persistent = True

    def __init__(self, spark: SparkSession):
        self.spark, self.depth, self.pending = spark, 0, None
        self.version = 0
        # The root by version, once it was read or set, and the one that the open transaction set, as (root,).
        self.known: tuple[int, str | None] | None = None
        self.named: tuple[str | None] | None = None

    # What a backend has to give.
    def tables(self) -> dict[str, DataFrame]:
        """The committed tables by name; pages may be missing."""
        raise NotImplementedError

    def commit(self, changes: dict[str, tuple[str, DataFrame]], version: int) -> None:
        """Makes changes (name -> append or replace, rows) visible together."""
        raise NotImplementedError

    def close(self) -> None:
        """Nothing to give back unless a backend says so."""

    def delete(self) -> None:
        """Drops the whole store."""
        raise NotImplementedError

    # Transactions.
    @contextlib.contextmanager
    def transaction(self):
        """Changes inside become visible together at its end, or not at all; inner ones join the outer."""
        if self.depth == 0:
            self.pending = {}
        self.depth += 1
        try:
            yield self
        except BaseException:
            self.depth -= 1
            if self.depth == 0:
                self.pending = self.named = None
            raise
        self.depth -= 1
        if self.depth == 0:
            changes, named = self.pending, self.named
            self.pending = self.named = None
            if changes:
                self.commit(changes, self.version + 1)
                self.version += 1
                if named:
                    self.known = self.version, named[0]
                elif self.known and self.known[0] == self.version - 1:
                    self.known = self.version, self.known[1]

    def _change(self, name: str, how: str, rows: DataFrame) -> None:
        with self.transaction():
            before = self.pending.get(name)
            if how == "append" and before:
                how, rows = before[0], before[1].unionByName(rows)
            self.pending[name] = (how, rows)

    def _table(self, name: str) -> DataFrame | None:
        """A table with the changes of the open transaction."""
        there = self.tables().get(name)
        how, rows = (self.pending or {}).get(name, (None, None))
        if how is None:
            return there
        return rows if how == "replace" or there is None else there.unionByName(rows)

    def _freed(self) -> DataFrame:
        found = self._table("freed")
        return self.spark.createDataFrame([], FREED) if found is None else found

    # Roots.
    def roots(self) -> DataFrame:
        found = self._table("roots")
        return self.spark.createDataFrame([], ROOTS) if found is None else found

    def get_root(self) -> str | None:
        """The root of the latest version that set one; None for an empty tree."""
        if self.named:
            return self.named[0]
        if self.known is None or self.known[0] != self.version:
            found = self.roots().agg(F.max_by(F.struct("root"), "version")).first()[0]
            self.known = self.version, found and found[0]
        return self.known[1]

    def set_root(self, root: str | None) -> None:
        if root is not None and not isinstance(root, str):
            raise TreeError("a root is a hash or None", root=root)
        with self.transaction():
            # A root set twice in a transaction counts as set last.
            self.pending["roots"] = "append", self.spark.createDataFrame([(self.version + 1, root)], ROOTS).coalesce(1)
            self.named = (root,)

    # Pages.
    def list(self) -> DataFrame | None:
        """All pages, freed ones too; None before any was put."""
        return self._table("pages")

    def list_root(self, root: str) -> DataFrame | None:
        """The pages that a root reaches."""
        there = self.list()
        return None if there is None else reachable(there, root, unique=True)

    def entries(self, root: str | None = None) -> DataFrame | None:
        """Entries under a root, the current one unless given: a read of any version that is still there."""
        there = self.list()
        return None if there is None else entries_at(there, root or self.get_root(), unique=True)

    def get(self, hash: str) -> DataFrame | None:
        there = self.list()
        return None if there is None else there.where(F.col("hash") == hash)

    def has(self, hashes) -> DataFrame:
        """Those of the hashes whose page is there."""
        wanted, there = as_hashes(self.spark, hashes), self.list()
        return wanted.limit(0) if there is None else wanted.join(there.select("hash").hint("merge"), "hash", "left_semi")

    def put(self, pages: DataFrame, unique: bool = False) -> None:
        """Adds pages; those that are there already are left alone, and their freed marks go. unique: none comes twice."""
        new, there = pages.select(*COLUMNS), self.list()
        if not unique:
            new = new.dropDuplicates(["hash"])
        with self.transaction():
            marks = self._table("freed")
            if marks is not None:
                self._change("freed", "replace", marks.join(pages.select("hash").hint("merge"), "hash", "left_anti"))
            self._change("pages", "append", new if there is None else new.join(there.select("hash").hint("merge"), "hash", "left_anti"))

    def delete_page(self, hashes) -> None:
        there = self.list()
        if there is not None:
            self._change("pages", "replace", there.join(as_hashes(self.spark, hashes).hint("merge"), "hash", "left_anti"))

    def copy(self, other: Store, root: str) -> None:
        """Takes over the pages under a root of another store."""
        found = other.list_root(root)
        if found is not None:
            self.put(found)

    def free(self, hashes) -> None:
        """Marks pages as freed by the commit under way, or drops them if the store isn't persistent. Freeing the root clears it."""
        gone, root = written(as_hashes(self.spark, hashes), "gone"), self.get_root()
        with self.transaction():
            if root is not None and not gone.where(F.col("hash") == root).isEmpty():
                self.set_root(None)
            if self.persistent:
                fresh = gone.join(self._freed().hint("merge"), "hash", "left_anti")
                self._change("freed", "append", fresh.select("hash", F.lit(self.version + 1).cast("long").alias("freed_at")))
            else:
                self.delete_page(gone)

    def is_referenced_at(self, epoch: int) -> DataFrame | None:
        """Pages with whether they still stood at an epoch: never freed, or not before it."""
        there = self.list()
        return None if there is None else there.join(self._freed().hint("merge"), "hash", "left").select("hash", F.expr(f"freed_at is null or freed_at >= {int(epoch)}").alias("referenced"))

    def page_refs(self, hash: str) -> list[str]:
        """A page's pointers, low first; [] for an unknown one."""
        there = self.list()
        row = None if there is None else there.where(F.col("hash") == hash).select(page_refs()).first()
        return [] if row is None else list(row[0])

    def missing_set(self, root: str) -> DataFrame:
        there = self.list()
        return as_hashes(self.spark, root) if there is None else missing_set(there, root)

    def gc(self, keep=None, epoch: int | None = None) -> dict[str, int]:
        """Drops pages that no kept root reaches, or those freed at an epoch or before; counts and bytes of what went."""
        if (keep is None) == (epoch is None):
            raise TreeError("a collection keeps roots, or goes by an epoch")
        there = self.list()
        if there is None:
            return {"freed_count": 0, "freed_bytes": 0}
        if keep is not None:
            stay = written(reachable(there, keep, unique=True), "kept")
        else:
            stay = written(there.join(self._freed().where(F.col("freed_at") <= epoch).hint("merge"), "hash", "left_anti"), "kept")
        size = F.coalesce(F.sum(F.length(F.to_json(F.struct(*COLUMNS)))), F.lit(0))
        (n, before), (m, after) = (t.agg(F.count("*"), size).first() for t in (there, stay))
        with self.transaction():
            self._change("pages", "replace", stay)
            self._change("freed", "replace", self._freed().join(stay.select("hash").hint("merge"), "hash", "left_semi"))
        return {"freed_count": n - m, "freed_bytes": before - after}


class MemoryStore(Store):
    """Tables of this session; a freed page is gone."""

    persistent = False
    #: Parts of a table after which an append writes it as one.
    PARTS = 16

    def __init__(self, spark: SparkSession):
        super().__init__(spark)
        self.parts: dict[str, list[DataFrame]] = {}
        self.held: dict[str, DataFrame] = {}

    def tables(self) -> dict[str, DataFrame]:
        return self.held

    def commit(self, changes, version: int) -> None:
        new = {}
        for name, (how, rows) in changes.items():
            old = self.parts.get(name, [])
            if how == "append" and len(old) >= self.PARTS:
                how, rows = "replace", reduce(DataFrame.unionByName, [*old, rows])
            # An append writes its own rows. Files of former tables stay for frames that still read them, as long as the session.
            new[name] = [*(old if how == "append" else []), written(rows, f"store-{name}")]
        self.parts |= new
        self.held = {name: reduce(DataFrame.unionByName, parts) for name, parts in self.parts.items()}

    def delete(self) -> None:
        self.close()
        self.parts, self.held, self.known = {}, {}, None


class SnapshotStore(MemoryStore):
    """Tables of this session that keep freed pages for readers of earlier roots."""

    persistent = True


class ParquetStore(Store):
    """A directory with the files of each commit and one manifest per version, which lists a table's directories."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark)
        if not path:
            raise TreeError("a directory is needed")
        self.path = path.rstrip("/")
        self.manifest = self._latest()
        self.version = self.manifest["version"]

    def _versions(self) -> list[int]:
        """Versions with a manifest, the latest first."""
        system, target = hadoop_path(self.spark, f"{self.path}/manifests")
        names = [s.getPath().getName() for s in system.listStatus(target)] if system.exists(target) else []
        return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)

    def _read(self, version: int) -> dict | None:
        """A version's manifest; None for one that its writer has not finished."""
        text = self.spark.read.text(self._manifest(version), wholetext=True).first()
        try:
            return json.loads(text[0]) if text else None
        except ValueError:
            return None

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifests/{version:012}.json"

    def _latest(self) -> dict:
        versions = self._versions()
        for version in versions:
            if (found := self._read(version)) is not None:
                return found | {"version": versions[0]}  # the number of an unfinished one isn't used again
        return {"version": 0, "tables": {}}

    def refresh(self) -> None:
        """Sees what others have committed meanwhile."""
        self.manifest = self._latest()
        self.version, self.known = self.manifest["version"], None

    def tables(self) -> dict[str, DataFrame]:
        out = {}
        for name, held in self.manifest["tables"].items():
            out[name] = self.spark.read.schema(StructType.fromJson(held["schema"])).parquet(*[f"{self.path}/{d}" for d in held["dirs"]])
        return out

    def commit(self, changes, version: int) -> None:
        manifest = {"version": version, "tables": {k: dict(v) for k, v in self.manifest["tables"].items()}}
        for name, (how, rows) in changes.items():
            place = f"data/v{version:012}-{name}-{uuid.uuid4().hex}"  # no other attempt at this version has it
            rows.write.parquet(f"{self.path}/{place}")
            held = manifest["tables"].get(name, {"dirs": [], "schema": rows.schema.jsonValue()})
            manifest["tables"][name] = {"schema": held["schema"], "dirs": [*(held["dirs"] if how == "append" else []), place]}
        self._publish(manifest)
        self.manifest = manifest

    def _publish(self, manifest: dict) -> None:
        """Writes the manifest under a name that only one writer can create; a reader takes it once it is whole."""
        system, target = hadoop_path(self.spark, self._manifest(manifest["version"]))
        try:
            out = system.create(target, False)
        except Py4JJavaError as e:
            raise TreeError("another commit came first; refresh and try again", version=manifest["version"]) from e
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    def gc(self, keep=None, epoch: int | None = None) -> dict[str, int]:
        """As for any store; then the files go that only manifests before the current one name, and these manifests."""
        found = super().gc(keep, epoch)
        stay = {d for held in self.manifest["tables"].values() for d in held["dirs"]}
        for version in self._versions():
            if version < self.manifest["version"]:
                held = self._read(version) or {"tables": {}}
                for place in {d for t in held["tables"].values() for d in t["dirs"]} - stay:
                    delete(self.spark, f"{self.path}/{place}")
                delete(self.spark, self._manifest(version))
        return found

    def delete(self) -> None:
        delete(self.spark, self.path)
        self.manifest, self.version, self.known = {"version": 0, "tables": {}}, 0, None

    def is_there(self) -> bool:
        return exists(self.spark, self.path)

