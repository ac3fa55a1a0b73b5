"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of 3 to 5 characters of a lower-cased text, hashed into ``BUCKETS`` buckets. Over all
labelled training rows, document counts per bucket and class give the log-count ratio r of each bucket; buckets whose
ratio is not distinguishable from chance are left out. Logistic regression on ``presence * r`` is fitted to at most
``max_fit_rows`` labelled rows, chosen by the hash of their ids (the only bounded sample here, and a parameter).

Defined cases: null and empty texts are texts without features and get the intercept's score. Labels other than 0 and 1,
labels of unknown ids and rows without an id train nothing; an id with several labels counts with the greatest. Without
two classes every text gets the smoothed share of label 1. Columns other than the named ones are ignored by
``scores`` and passed on by ``accepted``. Labels, languages, sources and ids are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe_memo import released
from .common import scratch_path, text_lists

BUCKETS = 1 << 20
SIZES = (3, 4, 5)
MAX_FIT_ROWS = 20_000
#: Least distance of a log-count ratio from 0, in standard errors.
LEAST_Z = 4.0
SLICE_BYTES = 256 << 10
#: Counts of buckets leave a task in batches of so many rows.
COUNT_ROWS = 1 << 16

_STEP, _LAST = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


class Model:
    """Weights of the buckets that count, and the intercept."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, intercept: float) -> None:
        self.buckets, self.weights, self.intercept = buckets, weights, intercept

    def plain(self) -> tuple[np.ndarray, np.ndarray, float]:
        return self.buckets, self.weights, self.intercept


def _weight_table(buckets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(BUCKETS)
    out[buckets] = weights
    return out


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, code points of the lower-cased texts with a space before and after each, row offsets)."""
    for lo, hi, rows in text_lists(texts, SLICE_BYTES):
        parts = [f" {t.lower()} " for t in rows]
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        yield lo, hi, codes, np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def _ngrams(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(size, bucket of the n-gram that starts at each place)."""
    hashes = np.zeros(len(codes), np.uint64)
    for k in range(max(SIZES)):
        n = len(codes) - k
        if n <= 0:
            return
        hashes = hashes[:n] * _STEP + codes[k:]
        if k + 1 in SIZES:
            yield k + 1, ((hashes ^ np.uint64(k + 1)) * _LAST >> np.uint64(44)).astype(np.int64)


def _present(codes: np.ndarray, offsets: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs; only buckets marked in ``counts`` if it is given."""
    if len(offsets) == 2:
        return _present_in_one(codes, counts)
    found = []
    for size, bucket in _ngrams(codes):
        place = np.flatnonzero(counts[bucket]) if counts is not None else np.arange(len(bucket))
        row = np.searchsorted(offsets, place, "right") - 1
        whole = place + size <= offsets[row + 1]
        found.append(row[whole] * BUCKETS + bucket[place[whole]])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs // BUCKETS, pairs % BUCKETS


def _present_in_one(codes: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The same for a slice of one text, piece by piece: memory does not grow with its n-grams."""
    seen = np.zeros(BUCKETS, bool)
    for lo in range(0, len(codes), SLICE_BYTES):
        for _, bucket in _ngrams(codes[lo:lo + SLICE_BYTES + max(SIZES) - 1]):
            seen[bucket[:SLICE_BYTES]] = True
    bucket = np.flatnonzero(seen if counts is None else seen & counts)
    return np.zeros(len(bucket), np.int64), bucket


def _labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label_id: str, label: str) -> DataFrame:
    known = labels.select(F.col(label_id).alias("id"), F.col(label).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    # one plan at every size: both sides are dealt by id, whatever the table of labels weighs
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(known.groupBy("id").agg(F.max("label").alias("label")).hint("merge"), "id")


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Document counts of every bucket for label 1 and for label 0, and the rows of each; tasks add up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        totals, n = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            n += np.bincount(label, minlength=2)
            for lo, hi, codes, offsets in _slices(batch.column("text")):
                row, bucket = _present(codes, offsets)
                of = label[lo:hi][row]
                for k in (0, 1):
                    totals[k] += np.bincount(bucket[of == k], minlength=BUCKETS)
        names = ["bucket", "ones", "zeros"]
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array(n[1:]), pa.array(n[:1])], names=names)
        some = np.flatnonzero(totals.any(axis=0))
        for at in range(0, len(some), COUNT_ROWS):
            part = some[at:at + COUNT_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(totals[k][part]) for k in (1, 0))], names=names)
        del totals, some
        released()

    sums = rows.select("text", "label").mapInArrow(count, "bucket bigint, ones bigint, zeros bigint").groupBy("bucket").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    got = sums.toArrow()  # one row for each bucket at most
    bucket, ones, zeros = (got.column(c).to_numpy() for c in ("bucket", "ones", "zeros"))
    p, q = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    real = bucket >= 0
    p[bucket[real]], q[bucket[real]] = ones[real], zeros[real]
    return p, q, int(ones[~real].sum()), int(zeros[~real].sum())


def fit(
    docs: DataFrame, labels: DataFrame, train: Column | None = None, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "toxic",
    max_fit_rows: int = MAX_FIT_ROWS, least_z: float = LEAST_Z, alpha: float = 1.0, penalty: float = 1e-4,
) -> Model:
    """``train``: a condition on the label table's rows; others are not looked at."""
    known = labels.filter(train) if train is not None else labels
    p, q, n1, n0 = _counts(_labelled(docs, known, doc_id, text, label_id, label))
    prior = Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((n1 + 0.5) / (n0 + 1.5))))
    if not n1 or not n0:
        return prior
    ratio = np.log((p + alpha) / (n1 + 2 * alpha)) - np.log((q + alpha) / (n0 + 2 * alpha))
    chosen = np.flatnonzero(np.abs(ratio) >= least_z * np.sqrt(1 / (p + alpha) + 1 / (q + alpha)))
    if not len(chosen):
        return prior
    place, scale, spark = np.full(BUCKETS, -1, np.int64), ratio[chosen], docs.sparkSession
    place[chosen] = np.arange(len(chosen))
    sent, width = spark.sparkContext.broadcast((chosen, scale)), len(chosen)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        buckets, values = sent.value
        marked, at = np.zeros(BUCKETS, bool), np.zeros(BUCKETS, np.int64)
        marked[buckets], at[buckets] = True, np.arange(len(buckets))
        for batch in batches:
            for lo, hi, codes, offsets in _slices(batch.column("text")):
                row, bucket = _present(codes, offsets, marked)
                cuts = np.searchsorted(row, np.arange(hi - lo + 1))
                index = at[bucket]
                yield pa.RecordBatch.from_arrays([
                    batch.column("label").slice(lo, hi - lo).cast(pa.float64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(index, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values[index])),
                ], names=["label", "indices", "values"])

    some = known.filter(F.col(label_id).isNotNull()).orderBy(F.xxhash64(label_id), label_id).limit(max_fit_rows)
    some = some.select(F.col(label_id).alias("id"), F.col(label).cast("int").alias("label")).filter("label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(some), "id").select("text", "label")  # max_fit_rows ids at most
    # few partitions of a bounded sample, dealt while it is text: gradients are added up without a shuffle in every iteration
    rows = texts.repartition(4).mapInArrow(features, "label double, indices array<int>, values array<double>")
    sparse = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(width).alias("size"), "indices", "values").alias("features")
    path = scratch_path(spark, "toxicity-sample")
    rows.select("label", sparse).write.parquet(path)
    # the struct is what a vector column is made of: it is read as one
    rows = spark.read.schema(T.StructType([T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())])).parquet(path)
    fitted = LogisticRegression(regParam=penalty, standardization=False, maxIter=60, tol=1e-4, family="binomial").fit(rows)
    return Model(chosen, np.asarray(fitted.coefficients) * scale, float(fitted.intercept))


def _scored(batch: pa.RecordBatch, text: str, table: np.ndarray, intercept: float) -> np.ndarray:
    out = np.full(batch.num_rows, intercept)
    marked = table != 0
    for lo, hi, codes, offsets in _slices(batch.column(text)):
        row, bucket = _present(codes, offsets, marked)
        out[lo:hi] += np.bincount(row, table[bucket], minlength=hi - lo)
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score of every document."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model.plain())  # BUCKETS weights at most

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        buckets, weights, intercept = sent.value
        table = _weight_table(buckets, weights)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scored(batch, "text", table, intercept))], names=["doc_id", "score"])

    return docs.mapInArrow(score, T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents with a score below ``threshold``, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model.plain())

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        buckets, weights, intercept = sent.value
        table = _weight_table(buckets, weights)
        for batch in batches:
            yield batch.filter(pa.array(_scored(batch, text, table, intercept) < threshold))

    return docs.mapInArrow(clean, docs.schema)
