"""Aligning the sentences of two versions of a text by the overlap of their bigrams, without comparing all pairs.

Sentences travel once, as arrays of token numbers, and meet their counterparts in blocks of bounded size: a version of any
length is cut into blocks of ``BLOCK`` positions, and only blocks of one pair of versions meet. In a block the target
side becomes an index from tokens to sentences, rare tokens first. The rare tokens of a source sentence (its prefix: all
but so many of the most frequent ones that a partner cannot do without the prefix) are counted through that index. The
counts bound the similarity of every pair from below and above, as the remaining tokens can at most all be shared; the
best lower bound so far rules out all pairs whose upper bound is beneath it, and only what is left is counted to the end.
A block returns one row for each source sentence, not one for each pair, and no table of tokens is made.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import han_bigram_codes

# the functions below travel to the executors with their tasks, which need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Positions of one side that meet those of the other in one task.
BLOCK = 2048
#: Pairs of sentences whose counts are held at once.
HELD_PAIRS = 1 << 20


class TargetIndex:
    """Tokens of the target sentences in order of rarity, and which sentences hold each."""

    def __init__(self, sizes: np.ndarray, tokens: np.ndarray) -> None:
        owner = np.repeat(np.arange(len(sizes)), sizes)
        self.known, place, count = np.unique(tokens, return_inverse=True, return_counts=True)
        rarity = np.argsort(count, kind="stable")
        self.rank = np.empty(len(rarity), np.int64)  # of a token of ``known``: its place from the rarest on
        self.rank[rarity] = np.arange(len(rarity))
        order = np.argsort(self.rank[place], kind="stable")
        self.owner = owner[order]
        self.first = np.concatenate(([0], np.cumsum(count[rarity])))
        self.pairs = np.sort(owner * (len(rarity) + 1) + self.rank[place])  # (sentence, token), to test one by one
        self.sizes = sizes

    def ranks(self, tokens: np.ndarray) -> np.ndarray:
        """Rarity rank of each token; the tokens that no target has come before all others, as -1."""
        if not len(self.known):
            return np.full(len(tokens), -1)
        at = np.minimum(np.searchsorted(self.known, tokens), len(self.known) - 1)
        return np.where(self.known[at] == tokens, self.rank[at], -1)

    def holds(self, sentence: np.ndarray, rank: np.ndarray) -> np.ndarray:
        keys = sentence * (len(self.rank) + 1) + rank
        at = np.minimum(np.searchsorted(self.pairs, keys), max(0, len(self.pairs) - 1))
        return self.pairs[at] == keys if len(self.pairs) else np.zeros(len(keys), bool)


def candidates(index: TargetIndex, sizes: np.ndarray, tokens: np.ndarray, threshold: float, best_only: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(source, target, overlap) of all pairs that reach the threshold; with ``best_only``, those that may be a source's best.

    All tokens of a source sentence follow each other in ``tokens``, each once.
    """
    rank = index.ranks(tokens)
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((rank, row))
    rank = rank[order]
    start = np.cumsum(sizes) - sizes
    # a partner has at least ceil(t * n) of the n tokens, so it has one of the n - ceil(t * n) + 1 rarest
    prefix = np.maximum(sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1, 0)
    rest = sizes - prefix
    n_targets = len(index.sizes)
    step = max(1, HELD_PAIRS // max(1, n_targets))
    for lo in range(0, len(sizes), step):
        hi = min(len(sizes), lo + step)
        within = np.arange(sizes[lo:hi].sum()) - np.repeat(start[lo:hi] - start[lo], sizes[lo:hi])
        r, source = rank[start[lo]:start[lo] + len(within)], np.repeat(np.arange(hi - lo), sizes[lo:hi])
        used = (within < np.repeat(prefix[lo:hi], sizes[lo:hi])) & (r >= 0)
        length = index.first[r[used] + 1] - index.first[r[used]]
        at = np.arange(length.sum()) + np.repeat(index.first[r[used]] - (np.cumsum(length) - length), length)
        counts = np.bincount(np.repeat(source[used] * n_targets, length) + index.owner[at], minlength=(hi - lo) * n_targets)
        met = np.flatnonzero(counts)
        s, t, c = met // n_targets, met % n_targets, counts[met]
        whole = sizes[lo:hi][s] + index.sizes[t]
        most = np.minimum(c + rest[lo:hi][s], np.minimum(sizes[lo:hi][s], index.sizes[t]))
        bound = np.full(hi - lo, threshold)
        if best_only:
            np.maximum.at(bound, s, c / (whole - c))
        open_ = most / (whole - most) >= bound[s] - 1e-12
        s, t, c = s[open_], t[open_], c[open_]
        # the frequent tokens of what is left, one by one
        n = rest[lo:hi][s]
        at = np.arange(n.sum()) + np.repeat((start[lo:hi] - start[lo] + prefix[lo:hi])[s] - (np.cumsum(n) - n), n)
        pair = np.repeat(np.arange(len(s)), n)
        shared = (r[at] >= 0) & index.holds(t[pair], r[at])
        c = c + np.bincount(pair[shared], minlength=len(s))
        enough = c / (sizes[lo:hi][s] + index.sizes[t] - c) >= threshold
        yield s[enough] + lo, t[enough], c[enough]


def _lists(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    lists = table.column(column).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def aligned(src: DataFrame, tgt: DataFrame, threshold: float, pair: str = "pair_id", src_idx: str = "i", tgt_idx: str = "j", sentence: str = "sentence",
            score: str = "p", pick: str = "all", min_drop: float | None = None, max_gap: float | None = None, block: int = BLOCK) -> DataFrame:
    """(pair, i, j, sim) of sentences whose bigram Jaccard similarity reaches ``threshold``. Exact.

    ``pick`` is ``best`` (for every source sentence the most similar target, the earliest of equals), ``first`` (the
    earliest that is similar and passes the gates) or ``all``. The gates ask, before anything is counted to the end, that
    the target's score be more than ``min_drop`` below the source's, and the two lengths differ by less than the share
    ``max_gap`` of the source's. Positions are non-negative.
    """
    if pick not in ("all", "best", "first") or (pick == "best" and (min_drop is not None or max_gap is not None)):
        raise ValueError("pick is all, best or first; gates come before the choice of the first only")
    gated = min_drop is not None or max_gap is not None

    def side(df: DataFrame, position: str, tag: str) -> DataFrame:
        extra = [F.length(sentence).alias(f"{tag}len"), F.col(score).cast("double").alias(f"{tag}p")] if gated else []
        rows = df.select(F.col(pair).alias("pair"), F.col(position).cast("bigint").alias(tag), han_bigram_codes(sentence).alias(f"{tag}tok"), *extra)
        return rows.filter((F.size(f"{tag}tok") > 0) & F.col("pair").isNotNull()).withColumn(f"{tag}b", F.floor(F.col(tag) / block))

    def dealt(rows: DataFrame, tag: str, other: DataFrame, position: str, other_tag: str) -> DataFrame:
        """The rows once for each block of the other side."""
        blocks = other.select(F.col(pair).alias("pair"), F.floor(F.col(position).cast("bigint") / block).alias(f"{other_tag}b")).distinct()
        return rows.join(blocks, "pair")

    left, right = side(src, src_idx, "i"), side(tgt, tgt_idx, "j")
    left, right = dealt(left, "i", tgt, tgt_idx, "j"), dealt(right, "j", src, src_idx, "i")
    names, key = ["pair", "i", "j", "sim"], ["pair", "ib", "jb"]
    schema = T.StructType([left.schema["pair"], *T._parse_datatype_string("i bigint, j bigint, sim double").fields])

    def match(whose: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        out = [[], [], []]
        if not len(a) or not len(b):
            return pa.table([pa.repeat(whose[0], 0), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        n, tokens = _lists(a, "itok")
        index = TargetIndex(*_lists(b, "jtok"))
        i, j = a.column("i").to_numpy(), b.column("j").to_numpy()
        for s, t, c in candidates(index, n, tokens, threshold, pick == "best"):
            if gated:
                keep = np.ones(len(s), bool)
                if min_drop is not None:
                    keep &= b.column("jp").to_numpy()[t] < a.column("ip").to_numpy()[s] - min_drop
                if max_gap is not None:
                    ilen, jlen = a.column("ilen").to_numpy()[s], b.column("jlen").to_numpy()[t]
                    keep &= np.abs(jlen - ilen) / np.maximum(ilen, 1) < max_gap
                s, t, c = s[keep], t[keep], c[keep]
            sim = c / (n[s] + index.sizes[t] - c)
            if pick != "all":
                order = np.lexsort((j[t], -sim, i[s]) if pick == "best" else (j[t], i[s]))
                s, t, sim = s[order], t[order], sim[order]
                first = np.ones(len(s), bool)
                first[1:] = i[s[1:]] != i[s[:-1]]
                s, t, sim = s[first], t[first], sim[first]
            for x, y in zip(out, (i[s], j[t], sim)):
                x.append(y)
        i, j, sim = (np.concatenate(x) if x else np.zeros(0) for x in out)
        return pa.table([pa.repeat(whose[0], len(i)), pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(sim, pa.float64())], names=names)

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(match, schema)
    if pick == "best":
        top = F.max(F.struct("sim", (-F.col("j")).alias("nj"))).alias("b")
        found = found.groupBy("pair", "i").agg(top).select("pair", "i", (-F.col("b.nj")).alias("j"), F.col("b.sim").alias("sim"))
    elif pick == "first":
        found = found.groupBy("pair", "i").agg(F.min(F.struct("j", "sim")).alias("b")).select("pair", "i", "b.j", "b.sim")
    return found.select(F.col("pair").alias(pair), F.col("i").alias(src_idx), F.col("j").alias(tgt_idx), "sim")
