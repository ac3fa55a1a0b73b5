"""Benchmark decontamination with suffix arrays over shards of the training text.

Every task turns its documents into shards (slices of whole documents), numbers the words of a shard, sorts all its
suffixes by prefix doubling and looks every suffix of the test items up by binary search. No training text is
shuffled. Test items are sent out in blocks of bounded size; all blocks meet every shard.

Words: A-Z lower-cased, then runs of digits, ASCII letters and code points from U+0080. A window is ``window``
consecutive words of an item; an item of fewer words, but not none, is one window.

Defined cases: null and empty texts have no words and are never contaminated. Items without words or without an id
match nothing. Repeated items and documents are judged row by row; equal item ids count once. Columns other than the
named ones are ignored by ``contamination`` and passed on by ``decontaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Hasher, text_slices

WINDOW = 10
#: Test items travel to the tasks in blocks of at most about so many characters.
BLOCK_CHARS = 2 << 20

MATCH = "array<struct<item_id:string,word:bigint,item_word:bigint,n_words:bigint>>"


class SuffixArray:
    """Suffixes of a sequence of word hashes, sorted by their first ``depth`` words; rows end with a separator."""

    def __init__(self, hashes: np.ndarray, rows: np.ndarray, depth: int) -> None:
        n_rows, n = len(rows) - 1, len(hashes)
        self.vocabulary, inverse = np.unique(hashes, return_inverse=True)
        self.row_start = rows[:-1] + np.arange(n_rows)  # of each row in the sequence with separators
        self.ids = np.zeros(n + n_rows, np.int64)
        self.row = np.repeat(np.arange(n_rows), np.diff(rows) + 1)
        self.ids[np.arange(n) + self.row[self._word_places(rows)]] = inverse + 1
        self.bits = max(1, int(len(self.vocabulary) + 1).bit_length())
        self.packed = max(1, 62 // self.bits)
        key = self._pack(self.packed)
        self.order = np.argsort(key)
        self.keys = key[self.order]
        reach, rank, order = self.packed, None, self.order
        while reach < depth and n:
            sorted_key = key[order]
            new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
            if new.all():
                break
            rank = np.empty(len(key), np.int64)
            rank[order] = np.cumsum(new)
            ahead = np.zeros(len(key), np.int64)
            ahead[:-reach] = rank[reach:]
            key = rank << np.int64(32) | ahead
            order = np.argsort(key)
            reach *= 2
        self.order = order

    @staticmethod
    def _word_places(rows: np.ndarray) -> np.ndarray:
        lengths = np.diff(rows)
        return np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)

    def _pack(self, k: int) -> np.ndarray:
        key = np.zeros(len(self.ids), np.int64)
        for i in range(k):
            key <<= np.int64(self.bits)
            key[:max(0, len(self.ids) - i)] |= self.ids[i:]
        return key

    def find(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds in ``order`` of the suffixes that begin with each window (rows of hashes, padded to one width)."""
        width = windows.shape[1]
        place = np.minimum(np.searchsorted(self.vocabulary, windows), max(0, len(self.vocabulary) - 1))
        inside = np.arange(width) < lengths[:, None]
        known = inside & (self.vocabulary[place] == windows) if len(self.vocabulary) else np.zeros_like(inside)
        ids = np.where(known, place + 1, 0)
        alive = np.flatnonzero((known | ~inside).all(axis=1) & (lengths > 0))
        lo, hi = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
        low, high = np.zeros(len(alive), np.int64), np.zeros(len(alive), np.int64)
        top = (1 << self.bits) - 1
        for i in range(self.packed):  # the first words by the packed keys
            have = i < lengths[alive]
            word = ids[alive, i] if i < width else 0
            low = low << self.bits | np.where(have, word, 0)
            high = high << self.bits | np.where(have, word, top)
        a, b = np.searchsorted(self.keys, low, "left"), np.searchsorted(self.keys, high, "right")
        for i in range(self.packed, width):  # the others one by one, inside the bounds so far
            left = b > a
            alive, a, b = alive[left], a[left], b[left]
            need = lengths[alive] > i
            if not need.any():
                break
            word = ids[alive[need], i]
            a2 = self._bound(a[need], b[need], i, word, 0)
            b2 = self._bound(a[need], b[need], i, word, 1)
            a[need], b[need] = a2, b2
        lo[alive], hi[alive] = a, b
        return lo, hi

    def _bound(self, lo: np.ndarray, hi: np.ndarray, i: int, word: np.ndarray, after: int) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) // 2
            at = np.minimum(self.order[np.minimum(mid, len(self.order) - 1)] + i, len(self.ids) - 1)
            less = self.ids[at] < word + after
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)


@dataclass
class TestBlock:
    """The distinct windows of a block of test items, and where in which items each occurs."""

    items: list[str]
    windows: np.ndarray
    lengths: np.ndarray
    first: np.ndarray  # offsets of each window's places in `item` and `item_word`
    item: np.ndarray
    item_word: np.ndarray

    def plain(self) -> tuple:
        """What is broadcast: a class of this package would need a copy of it on the executors."""
        return self.items, self.windows, self.lengths, self.first, self.item, self.item_word


def test_block(rows: list[tuple[str, str]], window: int) -> TestBlock:
    hasher = Hasher()
    windows, lengths, item, item_word, seen = [], [], [], [], set()
    names = sorted({name for name, _ in rows})
    number = {name: i for i, name in enumerate(names)}
    texts = pa.array([text for _, text in rows], pa.large_string())
    for lo, hi, data, offsets in text_slices(texts):
        hashes, cut = hasher.words(data, offsets)
        for r in range(lo, hi):
            words = hashes[cut[r - lo]:cut[r - lo + 1]]
            m = min(window, len(words))
            for k in range(len(words) - m + 1 if m else 0):
                if (entry := (number[rows[r][0]], k, words[k:k + m].tobytes())) in seen:
                    continue  # a repeated item
                seen.add(entry)
                windows.append(np.pad(words[k:k + m], (0, window - m)))
                lengths.append(m)
                item.append(number[rows[r][0]])
                item_word.append(k)
    if not windows:
        empty = np.zeros(0, np.int64)
        return TestBlock(names, np.zeros((0, window), np.uint64), empty, np.zeros(1, np.int64), empty, empty)
    table = np.column_stack([np.array(lengths, np.uint64), np.array(windows)])
    distinct, inverse = np.unique(table, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    by_window = np.argsort(inverse, kind="stable")
    first = np.searchsorted(inverse[by_window], np.arange(len(distinct) + 1))
    return TestBlock(names, distinct[:, 1:], distinct[:, 0].astype(np.int64), first, np.array(item)[by_window], np.array(item_word)[by_window])


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) for ranges that start at ``first`` and hold ``count`` places."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]


def _longest(row: np.ndarray, word: np.ndarray, item: np.ndarray, item_word: np.ndarray, length: np.ndarray):
    """Windows that follow each other in document and item become one longest match."""
    order = np.lexsort((word, word - item_word, item, row))
    row, word, item, item_word, length = row[order], word[order], item[order], item_word[order], length[order]
    same = (row[1:] == row[:-1]) & (item[1:] == item[:-1]) & (word[1:] - word[:-1] == 1) & (item_word[1:] - item_word[:-1] == 1)
    head = np.flatnonzero(np.concatenate(([True], ~same)))
    tail = np.concatenate((head[1:], [len(row)])) - 1
    return row[head], word[head], item[head], item_word[head], word[tail] + length[tail] - word[head]


def _shard(hashes: np.ndarray, rows: np.ndarray, blocks: list[TestBlock], window: int):
    """Per document of the shard: hit words, the item ids, and the longest matches."""
    n_rows = len(rows) - 1
    n_hit, items, matches = np.zeros(n_rows, np.int64), [set() for _ in range(n_rows)], [[] for _ in range(n_rows)]
    if not len(hashes):
        return n_hit, items, matches
    array = SuffixArray(hashes, rows, window)
    change = np.zeros(len(array.ids) + 1, np.int64)
    for block in blocks:
        lo, hi = array.find(block.windows, block.lengths)
        found, place = _spread(lo, hi - lo)
        if not len(found):
            continue
        at, length = array.order[place], block.lengths[found]
        np.add.at(change, at, 1)
        np.add.at(change, at + length, -1)
        where, entry = _spread(block.first[found], block.first[found + 1] - block.first[found])
        at, length = at[where], length[where]
        row = array.row[at]
        for r, w, i, iw, n in zip(*(x.tolist() for x in _longest(row, at - array.row_start[row], block.item[entry], block.item_word[entry], length))):
            items[r].add(block.items[i])
            matches[r].append({"item_id": block.items[i], "word": w, "item_word": iw, "n_words": n})
    hit = np.cumsum(change[:-1]) > 0
    totals = np.concatenate(([0], np.cumsum(hit)))
    n_hit = totals[np.append(array.row_start[1:], len(hit))] - totals[array.row_start]
    return n_hit, items, matches


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, window: int, block_chars: int) -> list:
    """The test items as broadcast blocks, none of more than about ``block_chars`` characters (or one item)."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).filter("item is not null and text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(total // block_chars) + 1
    out = []
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()
        out.append(spark.sparkContext.broadcast(test_block([tuple(r) for r in part], window).plain()))
    return out


def _judged(batch: pa.RecordBatch, text: str, hasher: Hasher, blocks: list, window: int) -> Iterator[tuple]:
    for lo, hi, data, offsets in text_slices(batch.column(text)):
        hashes, rows = hasher.words(data, offsets)
        n_hit, items, matches = _shard(hashes, rows, [TestBlock(*b.value) for b in blocks], window)
        yield lo, hi, np.diff(rows), n_hit, items, matches


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Per document: n_words, n_hit, the ids of items with occurring windows, and all longest verbatim matches with
    their first word in the document and in the item (counted from 0)."""
    blocks = _blocks(benchmark, item_id, item_text, window, block_chars)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(f"n_words bigint, n_hit bigint, item_ids array<string>, matches {MATCH}").fields])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        match_type = pa.list_(pa.struct([("item_id", pa.string()), ("word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]))
        for batch in batches:
            for lo, hi, n_words, n_hit, items, matches in _judged(batch, "text", hasher, blocks, window):
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(lo, hi - lo), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(matches, match_type),
                ], names=[f.name for f in schema])

    return docs.mapInArrow(judge, schema)


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The documents in which no window of a test item occurs, with all their columns."""
    blocks = _blocks(benchmark, item_id, item_text, window, block_chars)
    schema = docs.schema

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for lo, hi, _, n_hit, _, _ in _judged(batch, text, hasher, blocks, window):
                keep[lo:hi] = n_hit == 0
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(clean, schema)

