"""Gossip as a stream: pairs put at one replica, spread to the others, merged into every replica's state.

Events are rows (replica, key, value, ...), puts at a replica; spread() sends each to all. State is one merged value per
replica and key, dealt out by both, so a busy replica is no task of its own. Late and repeated events are harmless, for a
merger is idempotent and commutative; there is no watermark and nothing is dropped. Of effective_puts() a row comes out
when a value changes, which is what a replica would gossip; there mergers of plain values run per row, others, which are
Catalyst aggregates, go through merge_stream(). final_state() asks for the outcome only and takes the aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DataType, IntegerType, MapType, StructField, StructType

from ..functions.mergers import merger
from ..operators.entries import merge_values
from ..operators.spec import TreeError
from ..sources.tables import new_path, written

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STEPS = {"max": max, "min": min, "lww": max, "set": lambda a, b: a}


class MergeProcessor(StatefulProcessor):
    """Keeps one merged value per (replica, key) and emits it when it changes."""

    def __init__(self, step: str, value_type: DataType):
        self.step, self.schema = STEPS[step], StructType([StructField("value", value_type)])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("value", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues=None) -> Iterator[pd.DataFrame]:
        old = self.state.get()[0] if self.state.exists() else None
        now = old
        for frame in rows:
            for value in frame["value"].tolist():
                now = value if now is None else self.step(now, value)
        if now is not None and now != old:
            self.state.update((now,))
            yield pd.DataFrame({"replica": [key[0]], "key": [key[1]], "value": [now]})

    def close(self) -> None:
        pass


def spread(events: DataFrame, names: list) -> DataFrame:
    """Every put at every replica named: what gossip brings about. Replicas are few; rows grow with their number."""
    every = F.array(*[F.lit(n).cast(events.schema["replica"].dataType) for n in names])
    return events.select(F.explode(every).alias("replica"), "key", "value")


def effective_puts(events: DataFrame, which: str = "max") -> DataFrame:
    """A stream of the (replica, key, value) that events change; events is one of (replica, key, value)."""
    if which not in STEPS or isinstance(events.schema["value"].dataType, (StructType, ArrayType, MapType)):
        raise TreeError("only plain values of these mergers are merged row by row; use merge_stream", mergers=sorted(STEPS), merger=which, type=events.schema["value"].dataType.simpleString())
    out = StructType([StructField(c, events.schema[c].dataType) for c in ("replica", "key", "value")])
    return events.groupBy("replica", "key").transformWithStateInPandas(statefulProcessor=MergeProcessor(which, out["value"].dataType), outputStructType=out, outputMode="update", timeMode="None")


def run_to_end(events: DataFrame, which: str = "max") -> DataFrame:
    """All that a finite stream changes, as a table of the rows that came out."""
    return _run(effective_puts(events, which))


def _run(changed: DataFrame) -> DataFrame:
    """The rows that come out of a finite stream, with the batch of each."""
    spark: SparkSession = changed.sparkSession
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        path, marks = new_path(spark, "stream"), new_path(spark, "stream-marks")
        # Each batch is a directory of its own, written anew if it is repeated: one result per batch.
        query = changed.writeStream.outputMode("update").foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")).option("checkpointLocation", marks).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if provider is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    schema = StructType([*changed.schema.fields]).add("batch", IntegerType())
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def final_state(events: DataFrame, which: str = "max") -> DataFrame:
    """(replica, key, value) after a finite stream: the last change of each.

    Whether a row changed anything doesn't matter here, so values are merged by Spark's own aggregate, any merger's,
    before and after they are dealt out; a processor in Python would be called for every key.
    """
    found = _run(merge_values(events.select("replica", "key", "value"), which, "replica", "key"))
    last = found.groupBy("replica", "key").agg(F.max_by("value", "batch").alias("value"))
    return written(last, "state")


def merge_stream(events: DataFrame, path: str, which: str = "max"):
    """A query that folds a stream of (replica, key, value) into a table of snapshots under path, batch by batch.

    For any merger, aggregates included: each batch is merged with the last snapshot, and the new one is written beside
    it before it counts. Returns the started query.
    """
    merger(which)

    def fold(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        before = f"{path}/snapshot={batch - 1}"
        whole = rows.select("replica", "key", "value")
        if batch:
            whole = whole.unionByName(spark.read.parquet(before))
        merge_values(whole, which, "replica", "key").write.mode("overwrite").parquet(f"{path}/snapshot={batch}")

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", f"{path}/marks").trigger(availableNow=True).start()
