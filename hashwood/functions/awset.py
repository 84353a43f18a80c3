"""Add-wins sets after the published delta-state CRDT papers.

A value is struct<dots array<struct<elem, actor, ctr>>, ctx array<struct<actor, ctr>>>: a dot marks one addition, the
context tells up to which count each actor's additions have been seen. An element is in the set if it has a dot. A merge
keeps a dot if every side either has it or hasn't seen it; a removal is a context that covers a dot which is gone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DDL = "struct<dots:array<struct<elem:string,actor:string,ctr:bigint>>,ctx:array<struct<actor:string,ctr:bigint>>>"


def _seen(ctx: Column, dot: Column) -> Column:
    return F.exists(ctx, lambda c: (c["actor"] == dot["actor"]) & (c["ctr"] >= dot["ctr"]))


def single(elem: Column, actor: Column, ctr: Column) -> Column:
    """The set that one addition makes."""
    actor, ctr = actor.cast("string"), ctr.cast("bigint")
    return F.struct(F.array(F.struct(elem.cast("string").alias("elem"), actor.alias("actor"), ctr.alias("ctr"))).alias("dots"), F.array(F.struct(actor.alias("actor"), ctr.alias("ctr"))).alias("ctx"))


def merged(values: Column) -> Column:
    """One set from an array of them; arrays are as long as a key has replicas, not as the data."""
    dots = F.array_sort(F.array_distinct(F.flatten(F.transform(values, lambda v: v["dots"]))))
    kept = F.filter(dots, lambda d: F.forall(values, lambda v: F.array_contains(v["dots"], d) | ~_seen(v["ctx"], d)))
    seen = F.flatten(F.transform(values, lambda v: v["ctx"]))
    actors = F.array_sort(F.array_distinct(F.transform(seen, lambda c: c["actor"])))
    ctx = F.transform(actors, lambda a: F.struct(a.alias("actor"), F.array_max(F.transform(F.filter(seen, lambda c: c["actor"] == a), lambda c: c["ctr"])).alias("ctr")))
    return F.struct(kept.alias("dots"), ctx.alias("ctx"))


def add(value: Column, elem: Column, actor: Column) -> Column:
    """value with elem added by an actor, which takes the actor's next count; older dots of elem give way."""
    actor = actor.cast("string")
    ctr = F.coalesce(F.array_max(F.transform(F.filter(value["ctx"], lambda c: c["actor"] == actor), lambda c: c["ctr"])), F.lit(0).cast("bigint")) + 1
    dot = F.struct(elem.cast("string").alias("elem"), actor.alias("actor"), ctr.alias("ctr"))
    others = F.filter(value["dots"], lambda d: d["elem"] != elem.cast("string"))
    ctx = F.array_sort(F.concat(F.filter(value["ctx"], lambda c: c["actor"] != actor), F.array(F.struct(actor.alias("actor"), ctr.alias("ctr")))))
    return F.struct(F.array_sort(F.concat(others, F.array(dot))).alias("dots"), ctx.alias("ctx"))


def remove(value: Column, elem: Column) -> Column:
    """value without elem; the context still covers its dots, so the removal travels."""
    return F.struct(F.filter(value["dots"], lambda d: d["elem"] != elem.cast("string")).alias("dots"), value["ctx"].alias("ctx"))


def elements(value: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(value["dots"], lambda d: d["elem"])))
