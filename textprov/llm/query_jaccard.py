from __future__ import annotations

from .jaccard_join import near_duplicates
from .registry import query, table


@query("op1_jaccard_join")
def op1_jaccard_join(spark, d):
    """Not SQL: similarity of all pairs of sets. Tested against brute force."""
    return near_duplicates(table(spark, d, "documents", "doc_id", "text"))
