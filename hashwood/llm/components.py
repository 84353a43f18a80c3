"""Connected components as DataFrames: least labels of neighbours, then labels of labels, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def components(edges: DataFrame) -> DataFrame:
    """node and its component, the least node reachable, for every node of edges (a, b).

    Each round is narrow joins and aggregates that combine before they shuffle, so a node with many neighbours is no
    group of its own; a table is written per round, so that lineage stays short. Only labels that the last round changed
    go over the edges again: a node's label is never above what its neighbours' were a round before, so others can't lower it.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a").toDF("a", "b")).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).selectExpr("node", "least(node, b) label", "b < node changed"), "labels")
    while not labels.where("changed").isEmpty():
        here = labels.select("node", "label")
        near = both.join(labels.where("changed").selectExpr("node b", "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = here.join(near, "node", "left").selectExpr("node", "label old", "least(label, near) label")
        jump = here.toDF("label", "far")
        moved = written(step.join(jump, "label").selectExpr("node", "least(label, far) label", "least(label, far) <> old changed"), "labels", release=True)
        drop_written(labels)
        labels = moved
    drop_written(both)
    return labels.selectExpr("node", "label component")
