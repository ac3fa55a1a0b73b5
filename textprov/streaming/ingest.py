"""Incremental ingest, retrain trigger, scoring of arriving documents, and event-time aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.corpus import dedup_first
from ..plans.detect import detect
from .known import KnownTexts, read_or_empty

ANNOTATION_COLUMNS = ["text", "prob", "label", "text_hash"]


def append_new(batch: DataFrame, target: str, order: list[str], batch_id: int = -1) -> None:
    """Append the rows whose text hash the target does not hold, once each, marked with the number of their batch.

    The target's index of known texts decides which of its partitions are read at all. Running it again with the same
    batch appends nothing, so a replayed micro-batch does no harm.
    """
    fresh = dedup_first(batch.select("text", "prob", "label", *[c for c in order if c not in ("text", "prob", "label")]), order)
    rows = fresh.withColumn("text_hash", F.md5("text")).select(*ANNOTATION_COLUMNS, F.lit(batch_id).cast("bigint").alias("batch_id"))
    KnownTexts(batch.sparkSession, target).append(rows)


def ingest_reports(stream: DataFrame, parse: Callable[[DataFrame], DataFrame], target: str, checkpoint: str,
                   order: list[str], log: str | None = None) -> StreamingQuery:
    """Stream of report rows to annotations: parse, drop known texts, append. Runs over what is available and stops.

    ``parse`` turns a batch of reports into ``text, prob, label`` plus the ``order`` columns. Every annotation carries
    the number of its batch, so the log (``ingest_log``) follows from the data and no stop between two writes can lose it.
    ``log`` names a folder that gets the batch's row as well.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        append_new(parse(batch), target, order, batch_id)
        if log:
            ingest_log(batch.sparkSession, target).filter(F.col("batch_id") == batch_id).write.mode("append").parquet(log)

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_log(spark: SparkSession, target: str) -> DataFrame:
    """``batch_id, n_new``: new annotations of every batch, counted in the annotation table itself."""
    return read_or_empty(spark, target, "batch_id long").groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_new"))


def retrain_due(log: DataFrame, trained_upto: int = -1, threshold: int = 500) -> DataFrame:
    """New annotations since the last training and whether they reach the threshold, one row.

    A batch counts once even if its log row was written twice.
    """
    per = log.filter(F.col("batch_id") > trained_upto).groupBy("batch_id").agg(F.max("n_new").alias("n_new"))
    return per.agg(F.coalesce(F.sum("n_new"), F.lit(0)).alias("n_new"), F.max("batch_id").alias("last_batch")).withColumn(
        "due", F.col("n_new") >= threshold
    )


def score_arrivals(stream: DataFrame, versions: str, load_scorer: Callable[[str], Callable[[DataFrame], DataFrame]],
                   target: str, checkpoint: str, ids: list[str] | None = None) -> StreamingQuery:
    """Detection reports of arriving documents with the newest model.

    ``versions`` is a table ``(version, path)``; a batch takes the highest version, and the scorer is loaded again only
    when that changes.
    """
    held: dict = {}

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = spark.read.parquet(versions).orderBy(F.col("version").desc()).first()
        if held.get("version") != newest["version"]:
            held["version"], held["scorer"] = newest["version"], load_scorer(newest["path"])
        out = detect(batch, ids=ids, scorer=held["scorer"]).withColumn("model_version", F.lit(newest["version"]))
        out.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_arrivals(stream: DataFrame, time: str, delay: str = "1 hour", text: str = "text") -> DataFrame:
    """Drop repeated texts that arrive within the delay of each other."""
    return stream.withColumn("text_hash", F.md5(text)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["text_hash"])


def window_counts(events: DataFrame, time: str = "ts", width: str = "1 day", by: str = "event_type", delay: str | None = None) -> DataFrame:
    """Counts and value sums per tumbling window; the same code for batch and stream.

    Event times without zone are taken as UTC instants (set the session time zone to UTC).
    """
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    if delay:
        rows = rows.withWatermark(time, delay)
    out = rows.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), by, "n", "total")
