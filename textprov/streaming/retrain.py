"""Retrain trigger as a stateful stream: one counter per model over arriving annotations.

The state of a key is the number of annotations since its last training. When it reaches the threshold, a timer is set;
when the watermark has passed it, one row "due" leaves the stream and the counter starts again. Until then further
annotations only raise the number, so a burst triggers one training. Time is the annotations' own, so a replay gives the
same rows; state and timers are in the checkpoint: a stream that was stopped goes on where it was.

A key may hold most rows: batches are counted within their partitions first, and only counts are shuffled to the state.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DUE_SCHEMA = "model string, n_new bigint"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def timed_state(spark: SparkSession):
    """Streams started inside keep their state in the store that has timers and typed values."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class RetrainCounter(StatefulProcessor):
    def __init__(self, threshold: int, settle_ms: int) -> None:
        self.threshold, self.settle_ms = threshold, settle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n bigint, timed boolean")

    def handleInputRows(self, key, rows, timerValues):
        n, timed = self.count.get() if self.count.exists() else (0, False)
        last = 0
        for r in rows:
            n, last = n + r["n"], max(last, r["last_ms"])
        if n >= self.threshold and not timed:
            self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + self.settle_ms)
            timed = True
        self.count.update((n, timed))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, _ = self.count.get()
        self.count.update((0, False))
        yield Row(model=key[0], n_new=n)

    def close(self) -> None:
        pass


def due_rows(annotations: DataFrame, time: str, model: str = "label", threshold: int = 500, settle: int = 3600, delay: str = "0 seconds") -> DataFrame:
    """Stream ``model, n_new``: a row each time a model has ``threshold`` new annotations and ``settle`` seconds have passed
    since, by the watermark (the greatest ``time`` less ``delay``).

    Start it inside ``timed_state``. A null model is called ``none``; annotations without a time do not move the watermark.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            per = pa.Table.from_batches([batch]).group_by("model").aggregate([([], "count_all"), ("last_ms", "max")])
            yield from pa.table([per.column(c) for c in ("model", "count_all", "last_ms_max")], names=["model", "n", "last_ms"]).to_batches()

    rows = annotations.select(F.coalesce(F.col(model).cast("string"), F.lit("none")).alias("model"), F.coalesce(F.unix_millis(F.col(time).cast("timestamp")), F.lit(0)).alias("last_ms"))
    parts = rows.mapInArrow(counted, "model string, n bigint, last_ms bigint").withColumn("last", F.timestamp_millis("last_ms")).withWatermark("last", delay)
    # without the time column, rows that come late still count; the watermark is a matter of the timers only
    parts = parts.select("model", "n", "last_ms")
    return parts.groupBy("model").transformWithState(RetrainCounter(threshold, settle * 1000), DUE_SCHEMA, "Append", "EventTime")
