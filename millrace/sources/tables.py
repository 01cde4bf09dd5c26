"""The stored tables, read from one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``; columns and filters are pushed into the scan by whoever uses it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def streamed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same table as a stream of its files. A folder is streamed as it is, so that its parts may be folders of a column's values; a stream takes one file as its path only if that is a pattern."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    one = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(f"{folder}/{name}.parque[t]" if one else f"{folder}/{name}.parquet")
