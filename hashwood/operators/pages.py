"""Pages of Merkle search trees as a function of their entries.

The level of a key is the number of leading zeros of its digest. A page is a run of keys of one level between keys of
higher ones, so it is known by its level and the key of higher level before it. Of the two keys that bound a page, the
lower one's page holds its pointer: after the bound to its left, or as the low pointer of the page that the bound to its
right begins. All trees of a frame (column tree) are built at once.

Pages come from a pass over range partitions in key order, which holds a page per level (fold.py), and a second one over
the few rows at the partitions' ends; neither keeps a partition's rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encoding import level_of, prefixed
from ..sources.tables import written
from .fold import folded
from .spec import TreeSpec, text, text_of


def _made(rows: DataFrame, spec: TreeSpec, whole: bool, keep: bool) -> DataFrame:
    """fold.folded() over rows in order."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    order, key = kind.get("ord", kind["key"]), kind["key"]
    out = f"tree {kind['tree']}, hash string, level int, low string, entries array<struct<ord:{order},key:{key},value:{kind['value']},next:string>>, before_key {key}, until_key {key}, is_low boolean, said binary"
    return rows.mapInArrow(folded(spec.algorithm, whole, keep), out)


def _built(entries: DataFrame, spec: TreeSpec, keep: bool = True) -> DataFrame:
    """One row per page with the keys that bound it and on which of these it hangs; the roots' pages only unless kept."""
    tree = F.col("tree") if "tree" in entries.columns else F.lit(0)
    dealt = entries.select(tree.alias("tree"), "key", "value").repartitionByRange("tree", spec.order()).sortWithinPartitions("tree", spec.order())
    own_order = [spec.order().alias("ord")] if spec.sort_key else []
    tree_text = text_of(dealt, "tree").alias("tree_text")
    said = F.concat(prefixed(text_of(dealt, "key")), prefixed(text_of(dealt, "value"))).cast("binary").alias("said")
    rows = dealt.select("tree", tree_text, *own_order, "key", "value", said, level_of(text_of(dealt, "key"), spec.algorithm).alias("level"))
    first = written(_made(rows, spec, False, keep), "pages")
    # A task's first and last rows of a tree: a page per level at each end.
    e = F.col("entries")[0]
    ends = first.where("hash is null").select("tree", tree_text, *[e[c].alias(c) for c in (["ord"] if spec.sort_key else []) + ["key", "value"]], "said", "level", "low", e["next"].alias("next"))
    second = written(_made(ends.repartition("tree").sortWithinPartitions("tree", spec.order()), spec, True, keep), "pages-ends")
    return first.where("hash is not null").unionByName(second)


def outline(entries: DataFrame, spec: TreeSpec = TreeSpec()) -> DataFrame:
    """One row per page without hashes: tree, level, before_key, after_key (bounds), first_key, last_key, n_entries."""
    return _built(entries, spec).select("tree", "level", "before_key", F.col("until_key").alias("after_key"), F.expr("entries[0].key").alias("first_key"), F.expr("element_at(entries, -1).key").alias("last_key"), F.size("entries").cast("bigint").alias("n_entries"))


def pages(entries: DataFrame, spec: TreeSpec = TreeSpec()) -> DataFrame:
    """One row per page: tree, hash, level, low, entries array<struct<ord, key, value, next>>, first_key, low_of, after_key."""
    low_of, after_key = F.expr("if(is_low, until_key, null)").alias("low_of"), F.expr("if(is_low, null, before_key)").alias("after_key")
    return _built(entries, spec).select("tree", "hash", "level", "low", "entries", F.expr("entries[0].key").alias("first_key"), low_of, after_key)


def tree_roots(entries: DataFrame, spec: TreeSpec = TreeSpec()) -> DataFrame:
    """roots() of pages(): all pages are made and hashed, but only the roots' are written."""
    return _built(entries, spec, keep=False).select("tree", F.col("hash").alias("root"))


def roots(built: DataFrame) -> DataFrame:
    """tree and root: the page that hangs nowhere."""
    return built.where("low_of is null and after_key is null").select("tree", F.col("hash").alias("root"))


def refs(built: DataFrame) -> DataFrame:
    """One row per pointer: parent, child, pos (0 for low, else the entry's place from 1)."""
    low = built.where("low is not null").select(F.col("hash").alias("parent"), F.col("low").alias("child"), F.lit(0).alias("pos"))
    after = built.select("hash", F.posexplode("entries").alias("i", "e")).where("e.next is not null").select(F.col("hash").alias("parent"), F.col("e.next").alias("child"), (F.col("i") + 1).alias("pos"))
    return low.unionByName(after).distinct()


def page_refs():
    """A page's pointers as an array, low first."""
    return F.array_compact(F.concat(F.array("low"), F.transform("entries", lambda e: e["next"])))


def parents(built: DataFrame) -> DataFrame:
    """child, parent (null for a root) and slot: low, after or root."""
    pointers = refs(built).select(F.col("child").alias("hash"), "parent", F.when(F.col("pos") == 0, "low").otherwise("after").alias("slot"))
    return built.select("hash").distinct().join(pointers, "hash", "left").select(F.col("hash").alias("child"), "parent", F.coalesce("slot", F.lit("root")).alias("slot"))


def page_entries(built: DataFrame) -> DataFrame:
    """All entries with the hash and level of their page."""
    return built.select("hash", "level", F.explode("entries").alias("e")).select("hash", "level", "e.key", "e.value", "e.next")


def fold_pages(built: DataFrame, *aggregates) -> DataFrame:
    """Pages in the order of a walk (low subtree, page, subtrees of entries), that of their first keys; or aggregates over them."""
    return built.agg(*aggregates) if aggregates else built.orderBy(F.expr("entries[0].ord"))


def dump(built: DataFrame, spec: TreeSpec = TreeSpec()) -> DataFrame:
    """A tree's pages in walk order with their depth below the root, as indented lines."""
    depth = roots(built).select(F.col("root").alias("hash"), F.lit(0).alias("depth"))
    pointers, found = written(refs(built).select("parent", "child"), "refs"), [depth]
    while not depth.isEmpty():
        depth = written(depth.join(pointers, F.col("hash") == F.col("parent")).select(F.col("child").alias("hash"), (F.col("depth") + 1).alias("depth")).distinct(), "depth")
        found.append(depth)
    kind = built.schema["entries"].dataType.elementType["value"].dataType
    entries = F.array_join(F.transform("entries", lambda e: F.concat(e["key"].cast("string"), F.lit("="), F.coalesce(text(e["value"], kind), F.lit("null")))), ", ")
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.substring("hash", 1, 8), F.lit(" ("), F.col("level").cast("string"), F.lit("): "), entries)
    return built.join(reduce(DataFrame.unionByName, found), "hash").select("first_key", "depth", line.alias("line")).orderBy("first_key")
