"""Merge functions for values of equal keys, as Catalyst aggregates.

A merger must be commutative, associative and idempotent (a join of a semilattice); then the result depends neither on
the order of puts nor on how replicas exchange them. check_laws() tests that on sample values.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import awset


@dataclass(frozen=True)
class Merger:
    """name, and the aggregate that merges a column of values."""

    name: str
    merge: Callable[[Column], Column]


def _same(value: Column) -> Column:
    """A set tree's value is true; any other value of equal keys must be the same."""
    return F.when(F.count_distinct(value) <= 1, F.max(value)).otherwise(F.raise_error(F.lit("the set merger got different values for one key")).cast("boolean"))


MERGERS = {
    m.name: m
    for m in (
        Merger("set", _same),
        Merger("max", F.max),
        Merger("min", F.min),
        # struct<ts, ..., v>: the latest by its first fields; the rest break ties alike everywhere.
        Merger("lww", F.max),
        Merger("set_union", lambda v: F.array_sort(F.array_distinct(F.flatten(F.collect_list(v))))),
        # map<actor, count>: the largest count that anyone has seen of each actor.
        Merger("counter_max", lambda v: F.aggregate(F.collect_list(v), F.lit(None).cast("map<string,bigint>"), lambda a, m: F.when(a.isNull(), m).otherwise(F.map_zip_with(a, m, lambda _, x, y: F.greatest(x, y))))),
        Merger("awset", lambda v: awset.merged(F.collect_list(v))),
    )
}


def merger(which: str | Merger) -> Merger:
    if isinstance(which, Merger):
        return which
    if which not in MERGERS:
        raise ValueError(f"unknown merger {which!r}; one of {', '.join(MERGERS)}, or a Merger")
    return MERGERS[which]


def merge_values(entries: DataFrame, which: str | Merger, *by: str) -> DataFrame:
    """One row per key (columns by): its values merged."""
    found = merger(which)
    if found.name == "set":  # values that differ are an error, found without a distinct count
        return entries.groupBy(*by).agg(F.max("value").alias("value"), F.min("value").alias("_least")).select(*by, F.when(F.col("value").eqNullSafe(F.col("_least")), F.col("value")).otherwise(F.raise_error(F.lit("the set merger got different values for one key")).cast(entries.schema["value"].dataType)).alias("value"))
    return entries.groupBy(*by).agg(found.merge(F.col("value")).alias("value"))


def check_laws(spark: SparkSession, which: str | Merger, values: list, ddl: str) -> None:
    """Raises unless the merger is commutative, associative and idempotent on the values."""
    found = merger(which)

    def merged(rows: list):
        frame = spark.createDataFrame([(v,) for v in rows], f"value {ddl}")
        return merge_values(frame.withColumn("k", F.lit(1)), found, "k").select("value").first()[0]

    for a in values:
        if merged([a, a]) != merged([a]):
            raise ValueError(f"{found.name} isn't idempotent on {a!r}")
    for a, b in itertools.combinations(values, 2):
        if merged([a, b]) != merged([b, a]):
            raise ValueError(f"{found.name} isn't commutative on {a!r}, {b!r}")
    for a, b, c in itertools.combinations(values, 3):
        if merged([merged([a, b]), c]) != merged([a, merged([b, c])]):
            raise ValueError(f"{found.name} isn't associative on {a!r}, {b!r}, {c!r}")
