"""Reading the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A parquet table, pruned to ``columns``; its input splits are the partitions, whatever its size."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table as a file stream, whether it is one file or a folder of files.

    The path is a pattern that only the table fits: a stream takes folders and patterns, but no single file.
    """
    schema = read_table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/{name}.parque[t]")
