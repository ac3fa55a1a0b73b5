"""All registered queries."""

from __future__ import annotations

from . import queries_corpus, queries_scores, queries_text  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401


def flagship(spark, folder: str):
    return QUERIES["agg1_report"](spark, folder)
