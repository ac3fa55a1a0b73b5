"""Token ids as Parquet list columns, in the order of document ids.

``write_tokens`` deals the documents into ranges of ``doc_id``, encodes each range with the tokenizers library and writes
one row per document: metadata (id, token count, place in its range) beside the list of ids. Row groups and pages have
set sizes; the metadata columns carry page indexes, so a reader of a few documents or of the metadata alone touches few
pages. Ids are written either through a dictionary or, with ``encoding="delta"``, as delta binary packed integers.
``read_tokens`` returns the ids, and where each document starts in the sequence of all ids.

Defined cases: a null text is the empty text and yields only the end id. Rows with a null ``doc_id`` come last. Rows of
one id follow each other in the order of their texts. Columns other than the two named ones are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe_memo import SPACES, ChunkMemo, chunk_encoder, worker_memo
from .common import text_slices

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000
#: Bytes of text that are encoded in one call.
CALL_BYTES = 1 << 20

SCHEMA = "n_tokens bigint, part int, part_start bigint, ids array<int>"


def _encoder(path: str) -> ChunkMemo:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are dealt out by Spark
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    space, line = tokenizer.encode(" ", add_special_tokens=False).ids, tokenizer.encode("\n", add_special_tokens=False).ids
    begins = np.zeros(tokenizer.get_vocab_size() + 1, bool)
    if len(space) == len(line) == 1:  # byte level: which ids begin with a space, or are the line feed
        marks = tokenizer.id_to_token(space[0]), tokenizer.id_to_token(line[0])
        for token, i in tokenizer.get_vocab().items():
            begins[i] = token[0] == marks[0] or token == marks[1]

    return ChunkMemo(chunk_encoder(tokenizer, begins, lambda c: c[0] in " \n" and len(c) > 1 and c[1] not in SPACES))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, encoding: str = "dictionary", partitions: int | None = None) -> None:
    """Write the ids of every whole text, each followed by ``end_id``, to ``path``.

    ``tokenizer`` is a byte-level tokenizer file that every executor can open.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_last()).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, start = worker_memo(("byte level", tokenizer), lambda: _encoder(tokenizer)), 0
        for batch in batches:
            for lo, hi, data, rows_at in text_slices(batch.column("text"), CALL_BYTES):
                ids, cuts = memo.encode(data, rows_at)
                values, lengths = np.insert(ids, cuts[1:], end_id).view("<i4"), np.diff(cuts) + 1
                offsets = np.concatenate(([0], np.cumsum(lengths)))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(lo, hi - lo), pa.array(lengths), batch.column("part").slice(lo, hi - lo),
                    pa.array(start + offsets[:-1]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)),
                ], names=["doc_id", "n_tokens", "part", "part_start", "ids"])
                start += int(offsets[-1])

    schema = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string(SCHEMA).fields])
    out = dealt.mapInArrow(encode, schema).write.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
    out = out.option("parquet.page.row.count.limit", PAGE_ROWS).option("parquet.column.index.enabled", "true").option("compression", "zstd")
    if encoding == "delta":
        out = out.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false")
    elif encoding != "dictionary":
        raise ValueError("encoding is dictionary or delta")
    out.parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and n_tokens of every document; the columns of ids are not read."""
    rows = spark.read.schema("doc_id bigint, n_tokens bigint, part int, part_start bigint").parquet(path)
    return _placed(spark, path, rows).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document."""
    rows = spark.read.schema("doc_id bigint, " + SCHEMA).parquet(path)
    return _placed(spark, path, rows).select("doc_id", "start", "n_tokens", "ids")


def _placed(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    parts = spark.read.schema("n_tokens bigint, part int").parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(parts.select("part", before.alias("before")), "part").withColumn("start", F.col("before") + F.col("part_start"))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    rows = spark.read.schema("doc_id bigint, " + SCHEMA).parquet(path)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            data = memoryview(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False).tobytes())
            cuts = (np.concatenate(([0], np.cumsum(batch.column("n_tokens").to_numpy(zero_copy_only=False)))) * 4).tolist()
            sums = [zlib.crc32(data[a:b]) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_tokens", "part", "part_start")), pa.array(sums, pa.int64())], names=["doc_id", "n_tokens", "part", "part_start", "ids_crc32"])

    checked = rows.mapInArrow(check, "doc_id bigint, n_tokens bigint, part int, part_start bigint, ids_crc32 bigint")
    return _placed(spark, path, checked).select("doc_id", "start", "n_tokens", "ids_crc32")
