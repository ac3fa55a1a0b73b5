from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import query, table
from .toxicity import fit, scores


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


@query("op5_toxicity")
def op5_toxicity(spark, d):
    """Not SQL: a fitted model. Tested by its accuracy on the held-out fold."""
    docs = table(spark, d, "documents", "doc_id", "text")
    model = fit(docs, table(spark, d, "labels"), train=fold() != 0)
    out = scores(docs, model)
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
