"""Operators over two or more trees: merge, difference, intersection.

Trees that share most of their contents share most pages, and equal hashes mean equal contents. The pruned forms join the
narrow column of page hashes and then touch only the entries of pages that one side has alone. That is enough: a key of
such a page that the other tree holds too can't be in a shared page there, for then it would be in that page here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mergers import merge_values
from .pages import page_entries
from .spec import TreeSpec, text_of


def merge(spec: TreeSpec, *trees: DataFrame) -> DataFrame:
    """The entries of all trees, values of equal keys merged: one aggregate, whatever their number."""
    return merge_values(reduce(DataFrame.unionByName, [t.select("key", "value") for t in trees]), spec.merger, "key")


def _compared(entries: DataFrame) -> DataFrame:
    return entries.select("key", "value", text_of(entries, "value").alias("_text"))


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entries of a whose key b lacks or has with another value."""
    other = _compared(b).select(F.col("key").alias("_key"), F.col("_text").alias("_other"))
    return _compared(a).join(other, (F.col("key") == F.col("_key")) & F.col("_text").eqNullSafe(F.col("_other")), "left_anti").select("key", "value")


def unshared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pages of a that b lacks."""
    return a.join(b.select("hash").hint("merge"), "hash", "left_anti")


def diff_pages(a: DataFrame, b: DataFrame) -> DataFrame:
    """diff() of two trees from their pages."""
    return diff(page_entries(unshared(a, b)), page_entries(unshared(b, a)))


def merge_pages(spec: TreeSpec, a: DataFrame, b: DataFrame) -> DataFrame:
    """merge() of two trees from their pages: shared pages pass as they are."""
    shared = page_entries(a.join(b.select("hash").hint("merge"), "hash", "left_semi")).select("key", "value")
    return shared.unionByName(merge(spec, page_entries(unshared(a, b)), page_entries(unshared(b, a))))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entries of a whose key b has with the same value."""
    other = _compared(b).select(F.col("key").alias("_key"), F.col("_text").alias("_other"))
    return _compared(a).join(other, (F.col("key") == F.col("_key")) & F.col("_text").eqNullSafe(F.col("_other")), "left_semi").select("key", "value")
