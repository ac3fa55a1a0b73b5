"""Word n-gram language model as three tables, and the perplexity scores taken from it."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V
from ..functions.text import drop_space, let
from ..session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

JOIN, WORD = "\u0001", "\u0002"
DEFAULT_BASE = 20000.0
#: Bytes of joined tokens whose n-grams are counted together; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20


def default_tokens(text: Column) -> Column:
    """Single Han characters, runs of Latin letters and digits, other characters; white space is removed first.

    U+0001 and U+0002 mark n-grams and words in the counts and are removed. Any word segmenter can take its place, for example a pandas UDF returning an array of words.
    """
    return F.regexp_extract_all(drop_space(F.translate(text, JOIN + WORD, "")), F.lit(V.LM_TOKEN), F.lit(0))


@dataclass
class NgramModel:
    """``ngrams(gram, c)``, ``contexts(ctx, cn)`` and the one-row ``stats(total, vocab)``."""

    n: int
    ngrams: DataFrame
    contexts: DataFrame
    stats: DataFrame
    tokens: Callable[[Column], Column] = default_tokens

    def save(self, path: str) -> None:
        for name in ("ngrams", "contexts", "stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str, n: int = 3, tokens: Callable[[Column], Column] = default_tokens) -> "NgramModel":
        return cls(n, *[spark.read.parquet(f"{path}/{t}") for t in ("ngrams", "contexts", "stats")], tokens)


def _joined(tokens: Column) -> Column:
    """A token array as one string, null for none: it moves to Arrow tasks in less room than the array."""
    return let(tokens, lambda tok: F.when(F.size(tok) > 0, F.array_join(tok, JOIN)))


@dataclass
class _Chunk:
    """The n-grams of the texts ``lo`` to ``hi`` of a batch.

    ``grams``, ``totals``: the different ones and their counts; ``row, place, count``: what each text has of them; ``words``:
    the different words.
    """

    lo: int
    hi: int
    words: pa.Array
    grams: pa.Array
    totals: np.ndarray
    row: np.ndarray
    place: np.ndarray
    count: np.ndarray


def _chunks(joined: pa.Array, n: int, size: int) -> Iterator[_Chunk]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(joined), 0).to_numpy().astype(np.int64))
    lo = 0
    while lo < len(joined):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        tokens = pc.split_pattern(joined.slice(lo, hi - lo), JOIN)
        lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy().astype(np.int64)
        coded = pc.list_flatten(tokens).dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(hi - lo), lengths)
        at = np.flatnonzero(np.arange(len(code)) + n <= np.cumsum(lengths)[row])
        key, values = code[at], len(words)
        for k in range(1, n):
            if values * len(words) >= 1 << 63:
                seen, key = np.unique(key, return_inverse=True)
                values = len(seen)
            key, values = key * len(words) + code[at + k], values * len(words)
        _, first, place = np.unique(key, return_index=True, return_inverse=True)
        grams = pc.binary_join_element_wise(*[words.take(pa.array(code[at[first] + k])) for k in range(n)], JOIN)
        pair, count = np.unique(row[at] * max(1, len(first)) + place, return_counts=True)
        yield _Chunk(lo, hi, words, grams, np.bincount(place, minlength=len(first)), pair // max(1, len(first)), pair % max(1, len(first)), count)
        lo = hi


def _context(gram: str, n: int) -> Column:
    return F.substring_index(gram, JOIN, n - 1)


def train(texts: DataFrame, text: str = "text", n: int = 3,
          tokens: Callable[[Column], Column] = default_tokens) -> NgramModel:
    """Count n-grams and different words in one pass over the texts, into a checkpoint; contexts and totals follow
    from the counts. Arrow tasks count chunks of texts, so a chunk has one row for each different n-gram. Texts shorter than n
    add words but no n-grams."""
    size = CHUNK_BYTES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in _chunks(batch.column(0), n, size):
                marked = pc.binary_join_element_wise("", c.words, WORD)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([c.grams, marked]), pa.array(np.append(c.totals, np.ones(len(marked), np.int64)))], names=["gram", "c"])

    found = texts.select(_joined(tokens(F.col(text))).alias("_joined")).mapInArrow(count, "gram string, c long")
    counted = cut_lineage(found.groupBy("gram").agg(F.sum("c").alias("c")))
    is_word = F.col("gram").startswith(WORD)
    ngrams = counted.filter(~is_word)
    contexts = ngrams.groupBy(_context("gram", n).alias("ctx")).agg(F.sum("c").alias("cn"))
    stats = counted.agg(F.coalesce(F.sum(F.when(~is_word, F.col("c"))), F.lit(0)).alias("total"), F.count_if(is_word).alias("vocab"))
    return NgramModel(n, ngrams, contexts, stats, tokens)


def smoothed(c: Column, cn: Column, total: Column, vocab: Column) -> Column:
    """(c + 1) / (cn + vocab + 1), or 1 / (total + vocab + 1) for an unseen context."""
    c, cn = F.coalesce(c, F.lit(0)), F.coalesce(cn, F.lit(0))
    return F.when(cn == 0, F.lit(1.0) / (total + vocab + 1)).otherwise((c + 1) / (cn + vocab + 1))


def gram_key(tokens: list[Column]) -> Column:
    """64-bit key of an n-gram or context, given its tokens; no tokens have key 0."""
    return F.xxhash64(*tokens) if tokens else F.lit(0).cast("bigint")


def gram_probabilities(model: NgramModel, texts: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """One row per text row and different n-gram: ``ids, key, n, prob``, n being its occurrences in the text.

    Texts are cut into chunks of bounded size. A chunk is written with its different n-grams, to which its texts refer by
    place, and asks for each of them once: only these requests meet the two model tables, by 64-bit keys, and the answers go
    back to the chunk. All rows of a text leave one task together, so sums over a text are made before they are shuffled. Two
    n-grams of one key would be taken for one: among 100 million different ones the chance of any such pair is 0.03 %.
    """
    n, size = model.n, CHUNK_BYTES
    id_fields = [T.StructField(i, texts.schema[i].dataType) for i in ids]
    parts = T._parse_datatype_string("_part long, _places array<int>, _ns array<int>, _grams array<string>").fields

    def listed(values, lengths) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), values)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for c in _chunks(batch.column(len(ids)), n, size):
                if not len(c.grams):
                    continue
                rows, lengths = np.unique(c.row, return_counts=True)
                own = [pa.concat_arrays([batch.column(i).take(pa.array(rows + c.lo)), pa.nulls(1, batch.column(i).type)]) for i in range(len(ids))]
                numbers = [pa.array(v, pa.int32()) for v in (c.place, c.count)]
                lists = [listed(v, np.append(lengths, 0)) for v in numbers] + [listed(c.grams, np.append(np.zeros(len(rows), np.int64), len(c.grams)))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(rows) + 1, number)), *lists], names=[*ids, *[f.name for f in parts]])
                number += 1

    chunks = cut_lineage(texts.select(*ids, _joined(model.tokens(F.col(text))).alias("_joined")).mapInArrow(cut, T.StructType(id_fields + parts)))
    pieces = lambda c, k: [F.split_part(F.col(c), F.lit(JOIN), F.lit(i + 1)) for i in range(k)]
    grams = model.ngrams.select(gram_key(pieces("gram", n)).alias("key"), "c")
    contexts = model.contexts.select(gram_key(pieces("ctx", n - 1)).alias("ctx"), "cn")
    asked = chunks.filter(F.size("_grams") > 0).select("_part", F.posexplode("_grams").alias("_place", "gram"))
    asked = asked.select("_part", "_place", gram_key(pieces("gram", n)).alias("key"), gram_key(pieces("gram", n - 1)).alias("ctx"))
    known = asked.join(grams, "key", "left").join(contexts, "ctx", "left")
    total, vocab = model.stats.select("total").scalar(), model.stats.select("vocab").scalar()
    answers = known.select(F.col("_part").alias("_of"), "_place", "key", smoothed(F.col("c"), F.col("cn"), total, vocab).alias("prob"))

    def told(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("_place").to_numpy())
        places, ns = [left.column(c).combine_chunks() for c in ("_places", "_ns")]
        row = pa.array(np.repeat(np.arange(left.num_rows), pc.list_value_length(places).to_numpy()))
        place = order[pc.list_flatten(places).to_numpy()]
        own = [left.column(i).combine_chunks().take(row) for i in ids]
        return pa.table([*own, pa.array(right.column("key").to_numpy()[place]), pc.list_flatten(ns).cast(pa.int64()), pa.array(right.column("prob").to_numpy()[place])],
                        names=[*ids, "key", "n", "prob"])

    rows = chunks.filter(F.size("_grams") == 0).select(*ids, "_part", "_places", "_ns")
    out = T.StructType(id_fields + T._parse_datatype_string("key long, n long, prob double").fields)
    return rows.groupBy("_part").cogroup(answers.groupBy("_of")).applyInArrow(told, out)


def perplexity(model: NgramModel, texts: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """Perplexity per text; texts without an n-gram have no row."""
    p = gram_probabilities(model, texts, ids, text)
    bits = F.sum(F.col("n") * F.ln(F.greatest(F.col("prob"), F.lit(1e-12))))
    return p.groupBy(*ids).agg(F.exp(-bits / F.sum("n")).alias("perplexity"))


def human_base(scored: DataFrame, prob: str = "prob", limit: float = 0.4) -> DataFrame:
    """Mean perplexity of human records (missing probability counts as one half), one row, 20000 if there is none."""
    human = scored.filter(F.coalesce(F.col(prob), F.lit(0.5)) < limit)
    return human.agg(F.coalesce(F.avg("perplexity"), F.lit(DEFAULT_BASE)).alias("base"))


def perplexity_score(perplexities: DataFrame, base: DataFrame | float, group: str = "doc_id") -> DataFrame:
    """Per document: 0.6 times the share of predictable sentences plus 0.4 times how far the mean lies below 2."""
    b = base.select("base").scalar() if isinstance(base, DataFrame) else F.lit(float(base))
    rows = perplexities.withColumn("_rel", F.nullif(F.col("perplexity") / b, F.lit(0.0)))
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    share = F.avg(F.when(F.col("_rel") < 1.0, 1.0).when(F.col("_rel").isNotNull(), 0.0))
    score = unit(0.6 * share + 0.4 * unit(1.0 - F.avg("_rel") / 2))
    return rows.groupBy(group).agg(F.coalesce(score, F.lit(0.0)).alias("perplexity_score"))
