from __future__ import annotations

from pyspark.sql import functions as F

from .fingerprint import as_text, fingerprint, likeness
from .neighbours import bucket_order, in_buckets
from .registry import query, table


@query("op10_fingerprint")
def op10_fingerprint(spark, d):
    """Not SQL: the hash function. Tested against a brute-force version."""
    rows = in_buckets(table(spark, d, "documents", "doc_id", "text")).withColumn("own", fingerprint(F.col("text")))
    order = bucket_order()
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_own", F.lead("own").over(order)).filter(~F.col("ghost"))
    n, cut = F.char_length("text"), F.floor(F.char_length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.withColumn("edited", edited).withColumn("other", fingerprint(F.col("edited")))
    return rows.select(
        F.col("id").alias("doc_id"), F.char_length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
