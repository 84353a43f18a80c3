"""What a tree is made of, and the errors its operators raise."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from ..functions.encoding import ALGORITHMS, canonical
from ..functions.mergers import Merger, merger


class TreeError(Exception):
    """An error of a tree operator, with what it was about."""

    def __init__(self, reason: str, **info):
        super().__init__(reason)
        self.reason, self.info = reason, info

    def explained(self) -> dict:
        """The reason and its circumstances by name."""
        return {"reason": self.reason, **self.info}


def orderable(kind: DataType) -> bool:
    if isinstance(kind, (MapType, VariantType)):
        return False
    if isinstance(kind, ArrayType):
        return orderable(kind.elementType)
    return all(orderable(f.dataType) for f in kind.fields) if isinstance(kind, StructType) else True


@dataclass(frozen=True)
class TreeSpec:
    """key_cols and value_cols name columns of a source; no value column makes a set, whose values are true.

    sort_key orders keys by an expression over them instead of by themselves. It must tell keys apart.
    """

    key_cols: tuple[str, ...] = ("key",)
    value_cols: tuple[str, ...] = ()
    merger: str | Merger = "set"
    algorithm: str = "sha256"
    sort_key: str | None = field(default=None)

    def __post_init__(self):
        if not self.key_cols:
            raise TreeError("a tree needs a key column")
        if self.algorithm not in ALGORITHMS:
            raise TreeError("unknown hash algorithm", algorithm=self.algorithm)
        try:
            merger(self.merger)
        except ValueError as e:
            raise TreeError(str(e)) from None

    def rows(self, source: DataFrame) -> DataFrame:
        """(key, value) of a source; a row without any part of its key is no entry."""
        missing = [c for c in (*self.key_cols, *self.value_cols) if c not in source.columns]
        if missing:
            raise TreeError("the source lacks columns", missing=missing, columns=source.columns)
        pick = lambda cols: F.col(cols[0]) if len(cols) == 1 else F.struct(*cols)
        value = pick(self.value_cols) if self.value_cols else F.lit(True)
        out = source.where(" AND ".join(f"`{c}` IS NOT NULL" for c in self.key_cols)).select(pick(self.key_cols).alias("key"), value.alias("value"))
        if not orderable(out.schema["key"].dataType):
            raise TreeError("keys of this type have no order", type=out.schema["key"].dataType.simpleString())
        return out

    def order(self) -> Column:
        return F.expr(self.sort_key) if self.sort_key else F.col("key")

    def bounded(self, rows: DataFrame, comparison: str, bound) -> DataFrame:
        """Rows whose key stands in a comparison (<, <=, >, >=) with a bound, a value or a column, in the tree's order."""
        if bound is None:
            return rows
        if not self.sort_key:
            key, limit = F.col("key"), F.lit(bound)
            return rows.where({"<": key < limit, "<=": key <= limit, ">": key > limit, ">=": key >= limit}[comparison])
        held = rows.withColumn("bound_of_keys", F.lit(bound))
        return held.where(f"({self.sort_key}) {comparison} transform(array(bound_of_keys), key -> {self.sort_key})[0]").drop("bound_of_keys")


def plain(column: Column, kind: DataType) -> Column:
    """A value in which maps are arrays of entries by key, so that its JSON doesn't depend on an order within a map."""
    if isinstance(kind, MapType):
        entries = F.transform(F.map_entries(column), lambda e: F.struct(plain(e["key"], kind.keyType).alias("key"), plain(e["value"], kind.valueType).alias("value")))
        # Keys of a map are distinct, so that sorting by them alone is an order.
        return F.array_sort(entries, lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: plain(x, kind.elementType)) if nested(kind.elementType) else column
    if isinstance(kind, StructType) and any(nested(f.dataType) for f in kind.fields):
        return F.when(column.isNotNull(), F.struct(*[plain(column[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return column


def nested(kind: DataType) -> bool:
    return isinstance(kind, (StructType, ArrayType, MapType))


def text(column: Column, kind: DataType) -> Column:
    """The canonical text of a key or value."""
    if isinstance(kind, StructType) and not any(nested(f.dataType) for f in kind.fields):
        return canonical([column[f.name] for f in kind.fields])
    return F.to_json(plain(column, kind)) if nested(kind) else canonical([column])


def text_of(frame: DataFrame, name: str) -> Column:
    return text(F.col(name), frame.schema[name].dataType)


def in_order(rows: Column, orderable_rows: bool) -> Column:
    """An array of structs by their first field, ord, which tells them apart."""
    return F.array_sort(rows) if orderable_rows else F.array_sort(rows, lambda x, y: F.when(x["ord"] < y["ord"], -1).when(x["ord"] > y["ord"], 1).otherwise(0))
