from __future__ import annotations

from .common import scratch_path
from .registry import query, table
from .token_files import read_checksums, write_tokens


@query("op3_token_files")
def op3_token_files(spark, d):
    """Not SQL: byte-pair encoding. Tested against the library's own encoding of whole texts."""
    import public_tokenizers

    path = scratch_path(spark, "token-files")
    write_tokens(table(spark, d, "documents", "doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_checksums(spark, path)
