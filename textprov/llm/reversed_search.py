"""Ranked lexical search the other way round: the queries are indexed, and the documents stream past the index.

An item is a query. The inverted index of a block of items (term -> items and repeats) is broadcast; blocks are cut so that
an index has at most ``BLOCK_POSTINGS`` entries, which bounds the broadcast whatever the number of items. Documents are
read twice: first their terms are counted and those of the index are written, one row for each document, beside the
number of all its terms; the document counts and lengths over all documents follow from that table by aggregation. Then
the written counts stream through the index. A task keeps the best ``k`` documents of each item, which it replaces as
better ones come, and returns them at its end; these heaps are merged in two steps.

All arithmetic on scores is in 64-bit integers, apart from the logarithm of a term's weight.

Defined cases: a null text has no terms, an item without terms has no results, and so has an empty table. Rows of one
document id are documents of their own, and rows of one item id items of their own. A document without an id comes after
all others of its score. Columns other than the named ones are ignored. A term is known by a 64-bit hash of its bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Hasher, text_slices, written

#: Entries (item, term) of an index that is broadcast; one item of more terms than that is a block of its own.
BLOCK_POSTINGS = 2_000_000
#: Scores (document, item) that a task holds at once.
HELD_SCORES = 2_000_000
#: Entries (document, term, item) that a task adds up at once; one document of more is on its own.
HELD_ENTRIES = 2_000_000
#: Heaps of so many tasks meet in the first of the two merging steps.
MERGED_TASKS = 64


def item_postings(items: DataFrame, item_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Two written tables: item (a number of the row, which writing fixes), terms (hashes), repeats; and item, item_id."""
    rows = written(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(text).alias("text")), "items")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for lo, hi, data, at in text_slices(batch.column("text")):
                words, cuts = hasher.words(data, at)
                terms, repeats, sizes = [], [], [0]
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    t, r = np.unique(words[a:b], return_counts=True)
                    terms.append(t)
                    repeats.append(r)
                    sizes.append(len(t))
                upto = pa.array(np.cumsum(sizes), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column("item").slice(lo, hi - lo), pa.ListArray.from_arrays(upto, pa.array(np.concatenate(terms).view(np.int64))),
                    pa.ListArray.from_arrays(upto, pa.array(np.concatenate(repeats).astype(np.int64))),
                ], names=["item", "terms", "repeats"])

    counted = rows.select("item", "text").mapInArrow(count, "item bigint, terms array<bigint>, repeats array<bigint>")
    return written(counted.filter(F.size("terms") > 0), "item-terms"), rows.select("item", "item_id")


class Index:
    """Terms in order, and for each the items that hold it."""

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.combine_chunks().sort_by("item")
        self.items = rows.column("item").to_numpy()
        sizes = np.array([len(t) for t in rows.column("terms")], np.int64)
        flat = lambda c: np.concatenate([np.asarray(x, np.int64) for x in rows.column(c).to_pylist()]) if len(rows) else np.zeros(0, np.int64)
        hashes = flat("terms").view(np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.terms, first = np.unique(hashes[order], return_index=True)
        self.first = np.append(first, len(order))
        self.item = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.repeats = flat("repeats")[order]

    def plain(self) -> tuple[np.ndarray, ...]:
        return self.items, self.terms, self.first, self.item, self.repeats


def blocks_of(postings: DataFrame, limit: int) -> list[list[int]]:
    """Ranges of item numbers whose postings stay within the limit, from sums over ranges that are refined where needed."""
    sizes = postings.select("item", F.size("terms").cast("bigint").alias("n"))
    total = sizes.agg(F.sum("n").alias("n"), F.max("item").alias("last")).first()
    if total["n"] is None:
        return []
    todo, out = [(0, total["last"] + 1, total["n"])], []
    while todo:
        lo, hi, n = todo.pop()
        if n <= limit or hi - lo == 1:
            out.append([lo, hi])
            continue
        step = -(-(hi - lo) // 64)
        inner = sizes.filter((F.col("item") >= lo) & (F.col("item") < hi)).groupBy(F.floor((F.col("item") - lo) / step).alias("k")).agg(F.sum("n").alias("n")).orderBy("k").collect()
        held = None  # neighbouring ranges are joined as far as they fit
        for r in inner:
            a, b = lo + r["k"] * step, min(hi, lo + (r["k"] + 1) * step)
            if held and held[2] + r["n"] <= limit:
                held = (held[0], b, held[2] + r["n"])
            else:
                todo += [held] if held else []
                held = (a, b, r["n"])
        todo.append(held)
    return sorted(out)


def document_counts(docs: DataFrame, terms, doc_id: str, text: str) -> DataFrame:
    """doc_id, n (all its terms), terms (places in the broadcast ``terms``), tf; a row for each document with a term."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = Hasher(), terms.value
        for batch in batches:
            for lo, hi, data, at in text_slices(batch.column("text")):
                words, cuts = hasher.words(data, at)
                n = np.diff(cuts)
                place = np.minimum(np.searchsorted(known, words), len(known) - 1)
                hit = np.flatnonzero(known[place] == words)
                row = np.searchsorted(cuts, hit, "right") - 1
                keys, tf = np.unique(row * len(known) + place[hit], return_counts=True)
                upto = pa.array(np.searchsorted(keys, np.arange(hi - lo + 1) * len(known)), pa.int32())
                lists = [pa.ListArray.from_arrays(upto, pa.array(x)) for x in ((keys % len(known)).astype(np.int32), tf.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n), *lists], names=["doc_id", "n", "terms", "tf"])

    counted = rows.mapInArrow(count, "doc_id bigint, n bigint, terms array<int>, tf array<bigint>")
    return written(counted.filter("n > 0"), "document-terms")


class Heaps:
    """The best k documents of each item of a block, as arrays (item, score, whether the id is null, id)."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k, self.full = k, np.zeros(n_items, np.int64)  # the score that a document must reach; 0 while there is room
        self.rows = tuple(np.zeros(0, np.int64) for _ in range(4))

    def update(self, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        doc, item = np.nonzero((scores > 0) & (scores >= self.full))
        rows = tuple(np.concatenate(x) for x in zip(self.rows, (item, scores[doc, item], null[doc], ids[doc])))
        order = np.lexsort((rows[3], rows[2], -rows[1], rows[0]))
        rows = tuple(x[order] for x in rows)
        start = np.searchsorted(rows[0], np.arange(len(self.full) + 1))
        rank = np.arange(len(rows[0])) - start[rows[0]]
        self.rows = tuple(x[rank < self.k] for x in rows)
        last = rank == self.k - 1
        self.full[rows[0][last]] = rows[1][last]


def best_documents(counts: DataFrame, index, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """part, item, doc_id, score: the heaps of all tasks."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        items, _, first, item, repeats = index.value
        degree = np.diff(first)
        heaps = Heaps(len(items), k)
        rows_at_once = max(1, HELD_SCORES // max(1, len(items)))
        for batch in batches:
            ids, n = batch.column("doc_id"), batch.column("n").to_numpy(zero_copy_only=False)
            m = 25 + (75 * n * n_docs) // n_terms if n_docs * int(n.max(initial=0)) < 1 << 56 else np.array([25 + 75 * x * n_docs // n_terms for x in n.tolist()], np.int64)
            cuts, terms = batch.column("terms").offsets.to_numpy(), batch.column("terms").values.to_numpy()
            tf, null = batch.column("tf").values.to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = ids.fill_null(0).to_numpy()
            entries = np.concatenate(([0], np.cumsum(degree[terms])))[cuts]
            lo = 0
            while lo < len(ids):
                hi = min(len(ids), lo + rows_at_once, max(lo + 1, int(np.searchsorted(entries, entries[lo] + HELD_ENTRIES, "right")) - 1))
                a, b = cuts[lo], cuts[hi]
                row, t, f = np.repeat(np.arange(hi - lo), np.diff(cuts[lo:hi + 1])), terms[a:b], tf[a:b]
                value = weights[t] * ((1_000_000_000 * f) // (1000 * f + 8 * m[lo:hi][row]))
                each = degree[t]
                at = np.arange(each.sum()) + np.repeat(first[t] - (np.cumsum(each) - each), each)
                scores = np.zeros((hi - lo, len(items)), np.int64)
                np.add.at(scores.reshape(-1), np.repeat(row * len(items), each) + item[at], np.repeat(value, each) * repeats[at])
                heaps.update(scores, null[lo:hi], ids[lo:hi])
                lo = hi
        place, score, missing, ids = heaps.rows
        part = np.full(len(ids), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(items[place]), pa.array(ids, mask=missing.astype(bool)), pa.array(score)], names=["part", "item", "doc_id", "score"])

    return counts.mapInArrow(search, "part int, item bigint, doc_id bigint, score bigint")


def merged(heaps: DataFrame, k: int) -> DataFrame:
    """item, rank, doc_id, score: the heaps of some tasks first, then those that are left."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    first = Window.partitionBy("item", "part").orderBy(*order)
    some = heaps.withColumn("part", F.floor(F.col("part") / MERGED_TASKS)).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block_postings: int = BLOCK_POSTINGS,
) -> DataFrame:
    """item_id, rank, doc_id, score: for every item the k documents of highest score above 0."""
    spark: SparkSession = docs.sparkSession
    postings, names = item_postings(items, item_id, text)
    kind = names.schema["item_id"].dataType.simpleString()
    found = [spark.createDataFrame([], "item bigint, rank int, doc_id bigint, score bigint")]
    for lo, hi in blocks_of(postings, block_postings):
        index = Index(postings.filter((F.col("item") >= lo) & (F.col("item") < hi)).toArrow())
        sent, terms = spark.sparkContext.broadcast(index.plain()), spark.sparkContext.broadcast(index.terms)
        counts = document_counts(docs, terms, doc_id, text)
        totals = counts.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        held = counts.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # a row for each term of the index at most
        df = np.zeros(len(index.terms), np.int64)
        df[held.column("term").to_numpy()] = held.column("count").to_numpy()
        weights = np.array([math.floor(1000 * math.log((2 * totals["docs"] + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        if totals["docs"]:
            heaps = best_documents(counts, sent, weights, totals["docs"], totals["terms"], k)
            found.append(written(merged(heaps, k), "ranked"))
        sent.unpersist()
        terms.unpersist()
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.join(names, "item").select(F.col("item_id").cast(kind).alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
