"""All queries of this package."""

from __future__ import annotations

from . import query_bpe, query_chat, query_decontaminate, query_fingerprint, query_jaccard, query_line_dedup, query_quality, query_search, query_sentencepiece, query_token_files, query_toxicity, query_trie, query_url  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
