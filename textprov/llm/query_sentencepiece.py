from __future__ import annotations

from .registry import query, table
from .sentencepiece_codec import encoded


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op4_sentencepiece")
def op4_sentencepiece(spark, d):
    """Not SQL: pair encoding. Each row carries its own comparison with the SentencePiece library and its round trip."""
    return encoded(table(spark, d, "documents", "doc_id", "text"), model_path(), verify=True, keep_ids=False)
