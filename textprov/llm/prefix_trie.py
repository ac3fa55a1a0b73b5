"""Prefix trie of conversations by collapsing whole sequences.

Every turn carries a digest of its role and text; a prefix is known by the sum of the hashes of its (digest, position)
pairs, four lanes modulo 2^40, so the keys of all prefixes are running sums, which are taken in chunks of positions.
Identical conversations collapse into one weighted sequence, with the sorted list of its members as bounded pieces.
Sequences that are a proper prefix of another one fall to an anti-join; what is left are the leaves. Only the prefixes of
distinct sequences are then aggregated, with the weights of their sequences.

Sums over subtrees need no walk of the tree. The nodes whose smallest member is c form one path, which ends where c ends:
the part of its sequence that c owns. Over a node's subtree, the words of all distinct nodes are the owned words of all
sequences that pass through it, corrected for the one that owns the node; the words of all members are their totals less
what lies before the node.

Defined cases: a null role or text is empty, null turns come first, turns of one number follow the order of their digests,
repeated rows are repeated turns. Turns without a conversation id belong to no conversation. No conversation, no node.
Columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Positions whose running sums are taken together.
CHUNK_TURNS = 1024
#: Members in one piece of a list.
PIECE = 4096
#: A lane of a key is a sum modulo 2^40: a chunk and 2^23 chunks add up without overflow.
LANE_MASK = (1 << 40) - 1
LANES = 4
_SUMS = [f"s{i}" for i in range(LANES)]
_KEY = [f"k{i}" for i in range(LANES)]
_PARENT = [f"p{i}" for i in range(LANES)]
WORDS = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()


def _rest(x: Column) -> Column:
    return x.bitwiseAND(F.lit(LANE_MASK))


def placed(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, place (from 0), digest, words of every turn, written once. No conversation is gathered in one task."""
    role_of, text_of = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role_of).cast("string"), F.lit(":"), role_of, text_of), 256))
    rows = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv"), F.col(turn).cast("bigint").alias("turn"), digest.alias("digest"),
        F.regexp_count(text_of, F.lit(WORDS)).cast("bigint").alias("words"), F.monotonically_increasing_id().alias("nth"),
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("nth")]
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv", "digest", "words", F.spark_partition_id().alias("part"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            conv = batch.column("conv").to_numpy()
            if not len(conv):
                continue
            starts = np.flatnonzero(np.concatenate(([conv[0] != last], conv[1:] != conv[:-1])))
            local = np.arange(len(conv)) + (0 if len(starts) and starts[0] == 0 else seen)
            if len(starts):
                run = np.searchsorted(starts, np.arange(len(conv)), "right") - 1
                local = np.where(run >= 0, np.arange(len(conv)) - starts[np.maximum(run, 0)], local)
            last, seen = conv[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local)], names=["conv", "digest", "words", "part", "local"])

    local = written(dealt.mapInArrow(number, "conv bigint, digest binary, words bigint, part int, local bigint"), "turns")
    parts = local.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a partition goes on with one conversation of those before it at most: as many rows as there are partitions
    carried = parts.withColumn("before", before).filter(F.col("before").isNotNull()).select("conv", "part", "before")
    return local.join(F.broadcast(carried), ["conv", "part"], "left").select("conv", (F.col("local") + F.coalesce("before", F.lit(0))).alias("place"), "digest", "words")


def rebuilt(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv of every conversation, its turns after rebuilding: conv, pos, digest, words).

    A conversation starts with the first h turns of the first one of its family, h being the checksum of its id modulo
    ``most``; its own turns after its first h follow.
    """
    sizes = written(turns.groupBy("conv").agg((F.max("place") + 1).alias("n")), "sizes")
    h = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(most))
    base = F.col("conv") - F.col("conv") % family
    known = sizes.select("conv", base.alias("base"), h.alias("h"))
    firsts = sizes.filter(F.col("conv") == base).select(F.col("conv").alias("base"), "n")
    plan = known.join(firsts, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("given"))
    heads = turns.filter((F.col("conv") == base) & (F.col("place") < most - 1)).withColumnRenamed("conv", "base")
    given = plan.join(heads, "base").filter(F.col("place") < F.col("given")).select("conv", F.col("place").alias("pos"), "digest", "words")
    own = turns.join(plan, "conv").filter(F.col("place") >= F.col("h")).select("conv", (F.col("given") + F.col("place") - F.col("h")).alias("pos"), "digest", "words")
    return sizes.select("conv"), given.unionByName(own)


class Trie:
    """``nodes``: depth, key (k0..k3), conv, parent_conv, n_convs, n_children, n_leaves, saved_words.
    ``ends``: depth, key, part, nth, convs: pieces, in the order of part and nth, of the sorted members that end at a node."""

    def __init__(self, convs: DataFrame, turns: DataFrame) -> None:
        lanes = [_rest(F.xxhash64(F.lit(i), "digest", "pos")).alias(s) for i, s in enumerate(_SUMS)]
        rows = written(turns.select("conv", "pos", "words", F.floor(F.col("pos") / CHUNK_TURNS).alias("chunk"), *lanes), "rebuilt")
        sums = [*_SUMS, "words"]
        chunks = written(rows.groupBy("conv", "chunk").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums]).select(
            "conv", "chunk", "n", "words", *[_rest(F.col(s)).alias(s) for s in _SUMS]), "chunks")
        totals = chunks.groupBy("conv").agg(F.sum("n").alias("depth"), F.sum("words").alias("total"), *[_rest(F.sum(s)).alias(k) for s, k in zip(_SUMS, _KEY)])
        totals = convs.join(totals, "conv", "left").select("conv", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("depth", "total", *_KEY)])
        self.whole = written(totals, "whole")
        key = ["depth", *_KEY]
        sequences = written(self.whole.groupBy(*key).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("weight"), F.max("total").alias("total")), "sequences")
        prefixes = written(self._prefixes(rows, chunks, sequences), "prefixes")

        nodes = written(prefixes.groupBy(*key).agg(
            F.min("conv").alias("conv"), F.sum("weight").alias("n_convs"), F.sum(F.col("weight") * F.col("total")).alias("mass"), F.max("before").alias("before"),
            *[F.max(p).alias(p) for p in _PARENT]), "nodes")
        inner = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *[F.col(p).alias(k) for p, k in zip(_PARENT, _KEY)]).agg(F.count(F.lit(1)).alias("n_children"))
        inner = written(inner, "inner-nodes")
        leaves = sequences.join(inner, key, "left_anti").select("conv", F.lit(1).cast("bigint").alias("leaf"))
        owned = nodes.groupBy("conv").agg(F.min("before").alias("before"))
        # of each sequence: whether it is a leaf, and the words of the nodes that it owns
        of_sequence = written(sequences.join(owned, "conv", "left").join(leaves, "conv", "left").select(
            "conv", "total", F.coalesce("leaf", F.lit(0).cast("bigint")).alias("leaf"), F.coalesce(F.col("total") - F.col("before"), F.lit(0).cast("bigint")).alias("owned")), "of-sequences")
        through = prefixes.select(*key, "conv").join(of_sequence, "conv").groupBy(*key).agg(F.sum("leaf").alias("n_leaves"), F.sum("owned").alias("owned_all"))
        above = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(k).alias(p) for k, p in zip(_KEY, _PARENT)], F.col("conv").alias("parent_conv"))
        full = nodes.join(through, key).join(inner, key, "left").join(of_sequence.drop("leaf"), "conv").join(above, ["depth", *_PARENT], "left")
        distinct = F.col("owned_all") - F.col("owned") + F.col("total") - F.col("before")
        self.nodes = full.select(
            *key, "conv", "parent_conv", "n_convs", F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"), "n_leaves",
            (F.col("mass") - F.col("n_convs") * F.col("before") - distinct).alias("saved_words"),
        )

    @staticmethod
    def _prefixes(rows: DataFrame, chunks: DataFrame, sequences: DataFrame) -> DataFrame:
        """depth, key, key of the parent, words before the last turn, and the sequence: conv, weight, total."""
        kept = sequences.select("conv", "weight", "total")
        upto = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        sums = [*_SUMS, "words"]
        starts = chunks.join(kept, "conv").select("conv", "chunk", "weight", "total", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"{c}_0") for c in sums])
        inside = Window.partitionBy("conv", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        local = rows.join(kept.select("conv"), "conv", "left_semi").select("conv", "chunk", "pos", *_SUMS, *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_1") for c in sums])
        at = local.join(starts, ["conv", "chunk"])
        parent = {s: _rest(F.col(f"{s}_0") + F.col(f"{s}_1")) for s in _SUMS}
        below = at.select(
            (F.col("pos") + 1).alias("depth"), *[_rest(parent[s] + F.col(s)).alias(k) for s, k in zip(_SUMS, _KEY)], *[parent[s].alias(p) for s, p in zip(_SUMS, _PARENT)],
            (F.col("words_0") + F.col("words_1")).alias("before"), "conv", "weight", "total",
        )
        zero = F.lit(0).cast("bigint")
        root = kept.select(zero.alias("depth"), *[zero.alias(k) for k in _KEY], *[F.lit(None).cast("bigint").alias(p) for p in _PARENT], zero.alias("before"), "conv", "weight", "total")
        return below.unionByName(root)

    @property
    def ends(self) -> DataFrame:
        key = ["depth", *_KEY]
        n = int(self.whole.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = self.whole.select(*key, "conv").repartitionByRange(n, *key, "conv").sortWithinPartitions(*key, "conv").withColumn("part", F.spark_partition_id())

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nth = 0
            for batch in batches:
                m = len(batch)
                columns = [batch.column(c).to_numpy() for c in key]
                first = np.zeros(m, bool)
                first[:1] = True
                for c in columns:
                    first[1:] |= c[1:] != c[:-1]
                group = np.flatnonzero(first)
                within = np.arange(m) - np.repeat(group, np.diff(np.append(group, m)))
                starts = np.flatnonzero(within % PIECE == 0)
                at, places = pa.array(np.append(starts, m), pa.int32()), nth + np.arange(len(starts))
                nth += len(starts)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c[starts]) for c in columns), batch.column("part").take(pa.array(starts)), pa.array(places), pa.ListArray.from_arrays(at, batch.column("conv"))],
                    names=[*key, "part", "nth", "convs"],
                )

        return dealt.mapInArrow(cut, ", ".join(f"{c} bigint" for c in key) + ", part int, nth bigint, convs array<bigint>")


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, key, ends_sha256: of the members' decimal ids, joined by commas. Pieces stream through a task one after another."""
    key = ["depth", *_KEY]
    pieces = ends.select(*key, "part", "nth", F.array_join(F.col("convs").cast("array<string>"), ",").alias("text")).repartition(*key).sortWithinPartitions(*key, "part", "nth")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, out = None, None, []

        def flush() -> pa.RecordBatch:
            done = [pa.array([r[i] for r in out], pa.int64()) for i in range(len(key))]
            batch = pa.RecordBatch.from_arrays([*done, pa.array([r[-1] for r in out], pa.string())], names=[*key, "ends_sha256"])
            out.clear()
            return batch

        for batch in batches:
            for k, text in zip(zip(*(batch.column(c).to_pylist() for c in key)), batch.column("text").to_pylist()):
                if k == held:
                    state.update(b",")
                else:
                    if held is not None:
                        out.append((*held, state.hexdigest()))
                    held, state = k, hashlib.sha256()
                state.update(text.encode())
            yield flush()
        if held is not None:
            out.append((*held, state.hexdigest()))
            yield flush()

    return pieces.mapInArrow(digest, ", ".join(f"{c} bigint" for c in key) + ", ends_sha256 string")
