"""From raw documents to token ids, in five stages; each works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each result as Parquet in the shared folder and
reads it again as the next one's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textprov.llm.common import free_names, written
from textprov.llm.decontaminate import decontaminated
from textprov.llm.jaccard_join import one_of_each
from textprov.llm.line_dedup import deduplicated
from textprov.llm.query_sentencepiece import model_path
from textprov.llm.query_toxicity import fold
from textprov.llm.registry import table
from textprov.llm.sentencepiece_codec import encoded
from textprov.llm.toxicity import accepted, fit


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.5 or more go."""
    return accepted(docs, fit(docs, table(spark, sf_dir, "labels"), train=fold() != 0))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of 50 words or more go, and documents that lose all their words by it."""
    removed, = free_names(docs, "removed")
    out = deduplicated(docs, removed=removed)
    out = out.filter((F.col(removed) == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links of five-word shingles at a similarity of 0.8 or more join, the one of the least id stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, ids of every document that is left."""
    return encoded(docs, model_path())


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("sentencepiece encoding", sentencepiece),
]

#: Models and similarity joins are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
