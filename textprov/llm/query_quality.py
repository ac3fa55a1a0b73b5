from __future__ import annotations

from pyspark.sql import functions as F

from .kneser_ney import WORD_ORDER, WORDS, classified, trust
from .registry import query, table


@query("op7_quality")
def op7_quality(spark, d):
    """Trusted text: documents with quality label 1. Not SQL: n-grams of words. Tested against a brute-force model."""
    trusted = trust(table(spark, d, "labels", "doc_id", "quality"), "doc_id", F.col("quality") == 1)
    return classified(table(spark, d, "documents", "doc_id", "text", "lang"), trusted, order=WORD_ORDER, unit=WORDS)
