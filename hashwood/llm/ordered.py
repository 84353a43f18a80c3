"""Rows with their successor in an order, without one task that sees them all."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, BATCH_ROWS, arrow_schema, as_batch

LEAST_KEY = -(2**63)


def map_with_next(docs: DataFrame, rows: Callable[[list[int | None], list[str], str], dict], schema: str, buckets: int | None = None) -> DataFrame:
    """Applies rows to runs of (doc_id, text) by descending doc_id, each with the text that follows the run; the first row follows the last.

    Ids that part the order into buckets are quantiles, so each is the head of its bucket; heads are sent to the bucket
    before as well. A null doc_id counts as less than all others, and rows of one doc_id follow each other by text.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(LEAST_KEY)).alias("_key"))
    count = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = ", ".join(f"{i / count!r}D" for i in range(1, count + 1))
    found = keyed.select(F.expr(f"percentile_approx(_key, array({shares}), 100000)").alias("q"), F.max("_key").alias("m")).first()
    heads = np.unique(np.array([*(found.q or []), *([] if found.m is None else [found.m])], np.int64))[::-1]  # descending; as many as buckets at most
    ascending = heads[::-1].copy()

    @F.pandas_udf("int")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series(len(ascending) - 1 - np.searchsorted(ascending, key.to_numpy(), "left"), dtype="int32")

    dealt = keyed.withColumn("_bucket", bucket("_key"))
    is_head = dealt["_key"].isin([int(h) for h in heads]) if len(heads) <= 10 else F.element_at(F.array(*[F.lit(int(h)) for h in heads]), F.col("_bucket") + 1) == F.col("_key")
    before = F.pmod(F.col("_bucket") - 1, F.lit(max(1, len(heads))))
    copies = F.when(is_head, F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("copy")), F.struct(before.alias("b"), F.lit(True).alias("copy")))).otherwise(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("copy"))))
    spread = dealt.withColumn("_at", F.explode(copies)).select("_at.b", "_at.copy", "_key", "doc_id", "text")
    arrow = arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, texts, size, ended = None, [], [], 0, True
        for batch in batches:
            for b, copy, doc_id, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if b != now:
                    now, ended = b, False
                if ended:
                    continue  # further rows of a head's doc_id
                if copy:
                    if ids:
                        yield as_batch(rows(ids, texts, text), arrow)
                    ids, texts, size, ended = [], [], 0, True
                    continue
                if size >= BATCH_BYTES or len(ids) >= BATCH_ROWS:
                    yield as_batch(rows(ids, texts, text), arrow)
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)

    return spread.repartition("b").sortWithinPartitions("b", "copy", F.col("_key").desc(), "text").mapInArrow(run, schema)
