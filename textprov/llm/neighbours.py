"""The next document in descending order of ids, for all documents and without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Documents of so many successive ids are in one bucket, so many successive buckets in one larger one.
BUCKET_BITS, GROUP_BITS = 10, 10


def in_buckets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, text, bucket, ghost: buckets of successive ids, each with the document after its last one as a ghost row.

    Ordered by ``bucket_order()`` inside a bucket, every row but ghosts is followed by its next document in descending
    order of ids; the first document follows the last. A null id is the smallest; rows of one id are ordered by text.
    Only the texts are moved, once; ghosts are one row in 2 ** BUCKET_BITS.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(doc_id), F.lit(-(1 << 63))).alias("key"))
    rows = rows.withColumn("bucket", F.shiftright("key", BUCKET_BITS))
    tops = rows.groupBy("bucket").agg(F.max("key").alias("top")).withColumn("group", F.shiftright("bucket", GROUP_BITS))
    groups = tops.groupBy("group").agg(F.max("bucket").alias("highest"))
    everything = Window.orderBy(F.desc("group"))
    groups = groups.select("group", F.coalesce(F.lead("highest").over(everything), F.first("highest").over(everything)).alias("below"))
    inside = Window.partitionBy("group").orderBy(F.desc("bucket"))
    links = tops.withColumn("lower", F.lead("bucket").over(inside)).join(groups, "group").select(F.coalesce("lower", "below").alias("lower"), F.col("bucket").alias("into"))
    heads = written(links.join(tops.select(F.col("bucket").alias("lower"), "top"), "lower").select("top", "into"), "bucket-heads")
    ghosts = rows.join(heads, rows["key"] == heads["top"]).select("id", "text", "key", F.col("into").alias("bucket"), F.lit(True).alias("ghost"))
    return rows.select("id", "text", "key", "bucket", F.lit(False).alias("ghost")).unionByName(ghosts).repartition("bucket")


def bucket_order():
    return Window.partitionBy("bucket").orderBy("ghost", F.desc("key"), F.desc("text"))
