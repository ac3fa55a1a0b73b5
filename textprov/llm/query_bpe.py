from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query, table
from .speculative_bpe import decoded, encoded


@query("op13_bpe")
def op13_bpe(spark, d):
    """Not SQL: byte-pair encoding. Tested against the tokenizers library's own encoding and decoding of whole texts."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = decoded(encoded(table(spark, d, "documents", "doc_id", "text"), path), path)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return rows.select("doc_id", "n_tokens", ids.alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
