"""Walks over page pointers: level by level, as many rounds as the tree has levels.

Pages of the lowest level, nearly all there are, have no pointers. A walk goes over the others only, and meets the lowest
ones in one join at its end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .pages import page_entries, page_refs


def as_hashes(spark, hashes) -> DataFrame:
    """A frame (hash) from one, or from a hash or a list of some; None among them is left out."""
    if isinstance(hashes, DataFrame):
        return hashes.select("hash").where("hash is not null").distinct()
    listed = dict.fromkeys(h for h in ([hashes] if isinstance(hashes, str) else hashes or ()) if h is not None)
    if not listed:
        return spark.createDataFrame([], "hash string")
    return spark.range(0, 1, 1, 1).select(F.explode(F.array(*[F.lit(h) for h in listed])).alias("hash"))


def reached(built: DataFrame, roots) -> DataFrame:
    """Roots and all that pages pointed to by them point to: hashes of pages that are there, and the first ones that aren't."""
    spark = built.sparkSession
    children = lambda pages: pages.select(F.explode("refs").alias("hash"))
    inner = written(built.where("level > 0").select("hash", "level", page_refs().alias("refs")), "inner")
    frontier = as_hashes(spark, roots)
    found = [frontier := written(frontier, "frontier") if isinstance(roots, DataFrame) else frontier]
    while True:
        # Content addresses make no cycles; a page that several parents share may come again a level later.
        step = written(inner.join(frontier, "hash", "left_semi"), "step")
        found.append(children(step))
        higher = step.where("level > 1")
        if higher.isEmpty():
            return reduce(DataFrame.unionByName, found).distinct()
        frontier = children(higher)


def reachable(built: DataFrame, roots, unique: bool = False) -> DataFrame:
    """The pages that roots reach; unique says that no page is there twice."""
    # Hashes grow with the tree, so they aren't sent to all tasks.
    found = built.join(reached(built, roots).hint("merge"), "hash", "left_semi")
    return found if unique else found.dropDuplicates(["hash"])


def missing_set(built: DataFrame, root) -> DataFrame:
    """Hashes that must be fetched before the tree under root is whole, as far as present pages tell."""
    return reached(built, root).join(built.select("hash").hint("merge"), "hash", "left_anti")


def entries_at(built: DataFrame, root, unique: bool = False) -> DataFrame:
    """The entries of any root that the pages hold; none for an unknown one."""
    return page_entries(reachable(built, root, unique)).select("key", "value")


def entries_between(built: DataFrame, root, spec, lo=None, hi=None) -> DataFrame:
    """Entries under a root between two keys, both included: only pages whose span of keys meets these are read, a round per level."""
    frontier, found = as_hashes(built.sparkSession, root), []
    narrow = built.select("hash", "low", "entries")
    while True:
        # Content addresses make no cycles, so this ends below the last level.
        here = written(narrow.join(frontier, "hash", "left_semi").dropDuplicates(["hash"]), "descent")
        if here.isEmpty():
            break
        found.append(spec.bounded(spec.bounded(here.select(F.explode("entries").alias("e")).select("e.key", "e.value"), ">=", lo), "<=", hi))
        low = here.where("low is not null").select(F.col("low").alias("child"), F.lit(None).cast(here.schema["entries"].dataType.elementType["key"].dataType).alias("over"), F.expr("entries[0].key").alias("under"))
        after = here.select(F.posexplode("entries").alias("i", "e"), "entries").where("e.next is not null").select(F.col("e.next").alias("child"), F.col("e.key").alias("over"), F.expr("try_element_at(entries, i + 2).key").alias("under"))
        children = low.unionByName(after)
        met = _or_open(spec, _or_open(spec, children, "under", ">", lo), "over", "<", hi)
        frontier = met.select(F.col("child").alias("hash")).distinct()
    return reduce(DataFrame.unionByName, found) if found else built.select(F.explode("entries").alias("e")).select("e.key", "e.value").limit(0)


def _or_open(spec, children: DataFrame, name: str, comparison: str, bound) -> DataFrame:
    """Children whose bound by that name is open or stands in the comparison."""
    if bound is None:
        return children
    others = [c for c in children.columns if c != name]
    closed = spec.bounded(children.where(F.col(name).isNotNull()).withColumnRenamed(name, "key"), comparison, bound).withColumnRenamed("key", name)
    return children.where(F.col(name).isNull()).select(*others, name).unionByName(closed.select(*others, name))
