"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where the session names none and runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="hashwood-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    system, target = hadoop_path(spark, path)
    system.deleteOnExit(target)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a table: cuts lineage, and survives the loss of executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    system, target = hadoop_path(spark, path)
    return system.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    system, target = hadoop_path(spark, path)
    system.delete(target, True)
