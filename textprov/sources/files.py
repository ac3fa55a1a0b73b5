"""Report discovery, extraction cache, sinks and the issue log."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.report_fields import is_report_path
from ..functions.text import file_key


def discover_reports(spark: SparkSession, folder: str, with_content: bool = True) -> DataFrame:
    """Report files below a folder by extension and name key: ``path, modificationTime, length[, content]``.

    Paths are as they are stored, not URL-encoded; the reader passes empty files over.
    """
    df = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{html,htm,pdf,docx,HTML,HTM,PDF,DOCX}").load(folder)
    )
    df = df if with_content else df.select("path", "modificationTime", "length")
    return df.filter(is_report_path("path"))


def write_files(df: DataFrame, folder: str, path: str = "path", content: str = "content") -> int:
    """One file for each row, written by the tasks below a folder that all of them share; the number of files.

    ``path`` is relative and must be unique: a task that runs again writes the same files again. Null contents are empty.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        n = 0
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                at = f"{root.rstrip('/')}/{name.as_py()}"
                files.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with files.open_output_stream(at) as out:
                    out.write((text.as_py() or "").encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return df.select(path, content).mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def read_html_pages(spark: SparkSession, path: str) -> DataFrame:
    """Whole HTML files as ``path, html``."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def not_extracted(files: DataFrame, cache: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """Files whose key is not in the cache ``(path_key, text)``: only these need extraction.

    The key takes path and size without a mark between them, so ``a/1`` of 23 bytes has the key of ``a/12`` of 3. All columns
    that files and cache share, such as the path or a number of the file, must be equal as well, nulls to nulls.
    """
    keyed = files.withColumn("path_key", file_key(path, size))
    cols = [c for c in keyed.columns if c in cache.columns]
    same = F.lit(True)
    for c in cols:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return keyed.alias("a").join(cache.select(*cols).distinct().alias("b"), same, "left_anti")


def write_samples(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet", by: tuple[str, ...] = ("lang", "is_ai")) -> None:
    """Samples partitioned by language and class; ``mode='append'`` merges into an existing set."""
    writer = df.write.mode(mode)
    if by:
        writer = writer.partitionBy(*by)
    (writer.parquet if fmt == "parquet" else writer.json)(path)


def overwrite_partitions(df: DataFrame, path: str, by: tuple[str, ...] = ("lang", "is_ai")) -> None:
    """Replace the partitions that ``df`` has rows of and leave all others as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def merge_samples(df: DataFrame, path: str, text: str = "text", by: tuple[str, ...] = ("lang", "is_ai")) -> None:
    """Append the samples whose text their partition of ``path`` does not hold, each once: a rerun appends nothing.

    Only partitions that ``df`` has rows of are read, and of them only the texts' hashes are compared. Of equal samples of
    one partition one is kept, the least by its other columns. ``path`` must exist and have the columns of ``df``.
    """
    rest = [c for c in df.columns if c not in (text, *by)]
    key = F.sha2(F.col(text), 256)
    rows = df.filter(F.col(text).isNotNull()).groupBy(*by, key.alias("_key")).agg(F.min(F.struct(*rest, text)).alias("_row"))
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    touched = F.lit(False)
    for r in df.select(*by).distinct().collect():  # names of partitions
        one = F.lit(True)
        for c in by:
            one = one & (F.col(c).isNull() if r[c] is None else F.col(c) == F.lit(r[c]))
        touched = touched | one
    stored = stored.filter(touched).select(*by, key.alias("_key"))
    same = F.col("a._key") == F.col("b._key")
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    new = rows.alias("a").join(stored.alias("b"), same, "left_anti").select("_row.*", *by)
    new.select(*df.columns).write.mode("append").partitionBy(*by).parquet(path)


def issue_records(rows: DataFrame, description: Column | str, severity: Column | str | None = None,
                  scene: Column | str | None = None, key: Column | str | None = None) -> DataFrame:
    """Open issue records with id and time; severity and scene default to med and general."""
    def col(c, default):
        return F.lit(default) if c is None else F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(default))

    now = F.current_timestamp()
    text = F.col(description) if isinstance(description, str) else description
    tail = F.lit("") if key is None else F.concat(F.lit("-"), (F.col(key) if isinstance(key, str) else key).cast("string"))
    return rows.filter(F.coalesce(text, F.lit("")) != "").select(
        F.concat(F.lit("BUG-"), F.date_format(now, "yyyyMMddHHmmss"), tail).alias("id"),
        F.date_format(now, "yyyy-MM-dd HH:mm:ss").alias("time"),
        col(severity, "med").alias("severity"), col(scene, "general").alias("scene"), text.alias("description"),
        F.lit("open").alias("status"),
    )


def log_issues(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)
