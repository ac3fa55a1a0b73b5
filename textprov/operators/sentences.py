"""Documents to sentence and paragraph rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPLITTERS


def explode_sentences(docs: DataFrame, splitter: str | Callable[[Column], Column] = "service", text: str = "text",
                      **options) -> DataFrame:
    """One row per sentence: every column but the text, then ``sent_idx`` (dense from 0) and ``sentence``.

    ``splitter`` is a name from :data:`SPLITTERS` or a function; the choice belongs to a corpus and should be recorded
    with it.
    """
    split = SPLITTERS[splitter] if isinstance(splitter, str) else splitter
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(split(F.col(text), **options)).alias("sent_idx", "sentence"))


def explode_paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(F.split(F.col(text), "\n")).alias("para_idx", "paragraph"))


def flatten_table_rows(cells: DataFrame, keys: list[str], row: str = "row_idx", col: str = "col_idx",
                       text: str = "text") -> DataFrame:
    """Table cells to one line per table row: non-empty cells in order, joined by a bar."""
    kept = cells.filter(F.trim(F.col(text)) != "")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(col).alias("c"), F.trim(F.col(text)).alias("t"))))
    return kept.groupBy(*keys, row).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), " | ").alias("line"))
