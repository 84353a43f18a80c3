"""Helpers shared by the corpus operators: inputs, written tables, Arrow plumbing."""

from __future__ import annotations

import gc
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import new_path

#: Rows that go to a Python worker at once. With texts of some 100 KB a batch stays near 100 MB, with usual ones near 4 MB.
BATCH_ROWS = 1024
#: Bytes of text that mapped_texts() works on at once.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; further columns, whatever their names, are left out."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def written(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """The rows of df from a table in the shared folder: cuts lineage and outlives executors.

    release: have the driver look for shuffles that nothing refers to any more, so that their files go before the next, and
    return its memory.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    if release:
        give_back(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back(spark: SparkSession) -> None:
    """Has the driver return memory that nothing needs: Arrow's pool here, and in the JVM plans, shuffles and broadcasts that nothing refers to."""
    gc.collect()  # Python's proxies keep the JVM's plans
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Has the driver's C library return what the JVM has freed outside of its heap, as compilers of code do; False on a JVM that can't.

    The library keeps freed memory in an arena per thread, and every plan's code is compiled by several.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    given = gateway.new_array(jvm.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    # The server's own class is closed to reflection, its interface isn't.
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError:
        return False
    return True


def drop_written(df: DataFrame) -> None:
    """Deletes the files under a table of written() that is no longer read."""
    spark = df.sparkSession
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def mapped(df: DataFrame, rows: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Applies rows, from a batch to columns by name, to each Arrow batch of df."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    arrow = arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield as_batch(rows(batch), arrow)

    return df.mapInArrow(run, schema)


def mapped_texts(df: DataFrame, rows: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """As mapped, for (key, text) in df; long texts come in smaller batches, so that what rows makes of them stays small."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    arrow = arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, start, held = pc.binary_length(batch.column(1)).to_pylist(), 0, 0
            for i, n in enumerate(lengths):
                held += n or 0
                if held >= BATCH_BYTES or i + 1 == len(lengths):
                    yield as_batch(rows(batch.slice(start, i + 1 - start)), arrow)
                    start, held = i + 1, 0

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def as_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type, from_pandas=False) if not isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def texts(column: pa.Array) -> list[str]:
    """Strings of an Arrow column, null as the empty one."""
    return [x or "" for x in column.to_pylist()]


_HELD: dict[str, Callable[[], None]] = {}


def only(name: str, forget: Callable[[], None]) -> None:
    """Drops what other operators still remember in this Python worker; forget drops what this one will.

    Workers are used again by later stages, so without this each operator's memo would add to the next one's.
    """
    if others := [k for k in _HELD if k != name]:
        for other in others:
            _HELD.pop(other)()
        gc.collect()
        pa.default_memory_pool().release_unused()
    _HELD[name] = forget


def blocks(rows: Iterator, size: int) -> Iterator[list]:
    while block := list(itertools.islice(rows, size)):
        yield block


def key128(*columns: Column | str) -> Column:
    """128 hash bits of columns as a string of fixed length, nulls told from empty strings."""
    return F.md5(F.to_json(F.struct(*columns)))


#: DuckDB SQL for a text in which only A to Z are lowered, a null one being empty.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
