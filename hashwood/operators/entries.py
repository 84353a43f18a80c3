"""Reads and puts on a tree's entries: (key, value) rows with one row per key.

Point and range reads are filters, so a table sorted by key skips its files by their bounds; reads of the first or last
rows become TakeOrderedAndProject, which never sorts the whole. A batch of puts is one aggregate that combines before it
shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mergers import merge_values
from .spec import TreeError, TreeSpec, in_order, orderable


def build(source: DataFrame, spec: TreeSpec) -> DataFrame:
    """The entries of a source; values of equal keys are merged."""
    return merge_values(spec.rows(source), spec.merger, "key")


def put(entries: DataFrame, batch: DataFrame, spec: TreeSpec) -> DataFrame:
    """entries with a batch of (key, value) rows put; order and repeats don't matter."""
    return merge_values(entries.select("key", "value").unionByName(batch.select("key", "value")), spec.merger, "key")


def get(entries: DataFrame, key) -> DataFrame:
    """The entry of a key, or no row."""
    return entries.where(F.col("key") == F.lit(key)).select("key", "value")


def multi_get(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (key) with their values; null where absent."""
    return keys.select("key").join(entries.select("key", "value"), "key", "left")


def first(entries: DataFrame, spec: TreeSpec = TreeSpec()) -> DataFrame:
    return entries.select("key", "value").orderBy(spec.order()).limit(1)


def last(entries: DataFrame, spec: TreeSpec = TreeSpec()) -> DataFrame:
    return entries.select("key", "value").orderBy(spec.order().desc()).limit(1)


def last_n(entries: DataFrame, n: int, below=None, spec: TreeSpec = TreeSpec()) -> DataFrame:
    """The n largest keys, strictly below a bound if one is given, ascending."""
    return spec.bounded(entries, "<", below).select("key", "value").orderBy(spec.order().desc()).limit(n).orderBy(spec.order())


def key_range(entries: DataFrame, lo=None, hi=None, spec: TreeSpec = TreeSpec()) -> DataFrame:
    """Entries between two keys, both included, in the tree's order; None leaves an end open."""
    return spec.bounded(spec.bounded(entries.select("key", "value"), ">=", lo), "<=", hi)


def to_list(entries: DataFrame, spec: TreeSpec = TreeSpec()) -> DataFrame:
    """All entries ascending: a range-partitioned sort."""
    return entries.select("key", "value").orderBy(spec.order())


def keys(entries: DataFrame, spec: TreeSpec = TreeSpec()) -> DataFrame:
    return entries.select("key").orderBy(spec.order())


def positions(entries: DataFrame, spec: TreeSpec = TreeSpec()) -> DataFrame:
    """Entries with pos, their place from 1 in key order.

    Range partitions are numbered apart and then moved by the sizes of those before, so no task sees all rows.
    """
    from ..sources.tables import written

    ordered = entries.select("key", "value").repartitionByRange(spec.order()).sortWithinPartitions(spec.order())
    # The lower 33 bits count rows within a partition, the upper ones partitions.
    numbered = written(ordered.withColumn("_id", F.monotonically_increasing_id()), "positions")
    part, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    from pyspark.sql import Window

    sizes = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).withColumn("_before", F.sum("n").over(Window.orderBy("_part")) - F.col("n"))
    return numbered.withColumn("_part", part).join(sizes, "_part").select((F.col("_before") + row + 1).alias("pos"), "key", "value")


def select(entries: DataFrame, *, first=None, stop=None, match: Column | str | None = None, keys_only: bool = False, limit: int | None = None, spec: TreeSpec = TreeSpec()) -> DataFrame:
    """What a fold goes over: keys from first to stop that match, at most limit of them in key order."""
    found = key_range(entries, first, stop, spec)
    if match is not None:
        found = found.where(match)
    if limit is not None:
        if limit < 0:
            raise TreeError("a limit can't be negative", limit=limit)
        found = found.orderBy(spec.order()).limit(limit)
    return found.select("key") if keys_only else found


def fold(entries: DataFrame, *aggregates: Column, **options) -> DataFrame:
    """One row of aggregates over the selected entries, for functions that don't depend on order."""
    return select(entries, **options).agg(*aggregates)


def fold_ordered(entries: DataFrame, zero: Column, step: Callable[[Column, Column], Column], **options) -> DataFrame:
    """One row, result: step(accumulator, struct<key, value>) over the selected entries in key order.

    An ordered fold is one value carried through all entries, so they meet in one task: give a limit or a range for a
    large tree, or use fold() where order doesn't matter.
    """
    chosen, spec = select(entries, **options), options.get("spec", TreeSpec())
    plain_order = all(orderable(f.dataType) for f in chosen.schema.fields)
    rows = in_order(F.collect_list(F.struct(spec.order().alias("ord"), F.struct(*chosen.columns).alias("entry"))), plain_order)
    return chosen.agg(F.aggregate(rows, zero, lambda acc, e: step(acc, e["entry"])).alias("result"))


def foreach(entries: DataFrame, function: Callable, ordered: bool = True, **options) -> int:
    """Calls function on each selected entry for its effects; the number of calls.

    Ordered calls run on the driver, one partition of rows at a time; others on the executors.
    """
    chosen = select(entries, **options)
    if ordered:
        n = 0
        for row in chosen.orderBy(options.get("spec", TreeSpec()).order()).toLocalIterator():
            function(row)
            n += 1
        return n
    count = chosen.sparkSession.sparkContext.accumulator(0)

    def run(rows):
        for row in rows:
            function(row)
            count.add(1)

    chosen.foreachPartition(run)
    return count.value
