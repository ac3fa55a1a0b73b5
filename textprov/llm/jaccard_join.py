"""N-gram Jaccard join by chosen paths.

Sets are the shingles of ``words`` words of a text (one shingle of all words, if there are fewer). Texts with equal sets
are copies and become one node, and all work is on nodes. A node's set is embedded in ``COORDINATES`` minimum hashes, of
which two nodes share a fraction close to their similarity. In every run, a node goes to the buckets of the coordinates
that a hash function of the run samples; a bucket of more than ``limit`` nodes is split again by coordinates sampled
for that bucket, and small ones are compared pair by pair. The chances are such that each level keeps a pair at the
threshold with a fixed probability, and the number of runs follows from the target recall. Buckets that stay large after
``MAX_DEPTH`` levels are compared block by block, so that nothing is left out. Candidates are verified on the whole sets.

A pair is looked at in the least of the buckets that it shares only, hence links are counted once, and what leaves a task
is a row per node: its number of links and its root in the bucket's own forest. No table of pairs is made.

Defined cases: texts without words (null and empty ones too) are similar to nothing. Rows without an id take part, and
the class of such rows alone has a null id. Rows of one id and one text are one document. Words are those of ``common``:
A-Z lower-cased, runs of digits, ASCII letters and code points from U+0080. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Hasher, SLICE_BYTES, free_names, mixed, text_slices, written

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999999
#: Nodes of a bucket that is compared pair by pair; of a group that is compared one pair after another.
LIMIT, PAIRWISE = 4000, 64
MAX_DEPTH = 4
COORDINATES = 128
#: Coordinates that a pair at ``threshold - SLACK`` is expected to share in the buckets of a level.
BRANCH, SLACK = 2.0, 0.1
#: Standard deviations of the shared fraction below the threshold at which a pair is no candidate.
DEVIATIONS = 5.0

_ODD = mixed(np.arange(1, WORDS * 16, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
_FACTORS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)) | np.uint64(1)
_PLACES = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def chance(threshold: float) -> float:
    """Probability that a coordinate is sampled for a bucket."""
    return min(1.0, BRANCH / ((threshold - SLACK) * COORDINATES))


def runs_for(recall: float, threshold: float) -> int:
    """Runs after which a pair at the threshold is in a common bucket of any depth with probability ``recall``."""
    shared, lost = threshold * COORDINATES * chance(threshold), 0.0
    for _ in range(200):  # the chance that a branching process with so many children dies out
        lost = math.exp(-shared * (1 - lost))
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def shingle_sets(hashes: np.ndarray, rows: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row."""
    out = []
    n = len(hashes)
    full = np.zeros(0, np.uint64)
    if n >= words:
        full = hashes[:n - words + 1] * _ODD[0]
        for k in range(1, words):
            full = mixed(full) + hashes[k:n - words + 1 + k] * _ODD[k]
        full = mixed(full)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(full[a:b - words + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for k in range(a, b):
                h = mixed(h) + hashes[k:k + 1]
            out.append(mixed(h))
        else:
            out.append(full[:0])
    return out


def _signature(s: np.ndarray) -> np.ndarray:
    low = np.full(COORDINATES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(s), 4096):
        low = np.minimum(low, np.multiply.outer(_FACTORS, s[a:a + 4096]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32)


def _sampled(signatures: np.ndarray, buckets: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the child buckets of each row's bucket."""
    value = mixed(signatures.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) ^ _PLACES ^ buckets[:, None])
    row, at = np.nonzero(value < np.uint64(int(p * 2.0**63) * 2))
    return row, mixed(value[row, at] ^ buckets[row]).astype(np.int64)


def _node(s: np.ndarray, own: str) -> bytes:
    """16 bytes that stand for the set; a text without words gets a node of its own."""
    if not len(s):
        return hashlib.blake2b(own.encode(), digest_size=16).digest()
    return np.array([np.add.reduce(s), np.add.reduce(mixed(s ^ np.uint64(0x2545F4914F6CDD1D)))], np.uint64).tobytes()


def sketches(docs: DataFrame, doc_id: str, text: str, words: int, threshold: float, runs: int) -> DataFrame:
    """id, text_hash, node, n (shingles), signature, bits of it, keys (buckets of the first level) of every document."""
    docs = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    schema = T.StructType([docs.schema["id"], *T._parse_datatype_string("text_hash bigint, node binary, n int, signature binary, bits binary, keys array<bigint>").fields])
    p, roots = chance(threshold), mixed(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                sets = shingle_sets(*hasher.words(data, offsets), words)
                ids = batch.column("id").slice(lo, hi - lo)
                nodes = [_node(s, "" if len(s) else f"without words: {i}") for s, i in zip(sets, ids.to_pylist())]
                signatures = np.array([_signature(s) for s in sets])
                some = np.array([len(s) > 0 for s in sets])
                found = [_sampled(signatures, np.full(len(sets), r), p) for r in roots]
                row, key = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                row, key = row[some[row]], key[some[row]]
                order = np.argsort(row, kind="stable")
                cuts = np.searchsorted(row[order], np.arange(len(sets) + 1))
                yield pa.RecordBatch.from_arrays([
                    ids, batch.column("text_hash").slice(lo, hi - lo), pa.array(nodes, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in signatures], pa.binary()),
                    pa.array([b.tobytes() for b in _sketch_bits(signatures)], pa.binary()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(key[order])),
                ], names=[f.name for f in schema])

    return docs.mapInArrow(sketch, schema)


def _shared(rows: DataFrame, name: str) -> DataFrame:
    """(bucket, node, size) of the buckets with two nodes or more."""
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return written(rows.join(sizes, "bucket").select("bucket", "node", "size"), name)


def buckets(nodes: DataFrame, threshold: float, limit: int) -> DataFrame:
    """(bucket, part, side, node): what is compared pair by pair. Large buckets are split by chosen paths, and what stays
    large by blocks: in ``part`` of two blocks only pairs of different sides count; side 2 is for pairs of all rows."""
    p = chance(threshold)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signatures = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(batch.num_rows, COORDINATES)
            row, key = _sampled(signatures, batch.column("bucket").to_numpy().astype(np.uint64), p)
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("node").take(pa.array(row))], names=["bucket", "node"])

    level = _shared(nodes.select(F.explode("keys").alias("bucket"), "node"), "buckets")
    leaves = level.filter(F.col("size") <= limit).select("bucket", F.lit(0).alias("part"), F.lit(2).alias("side"), "node")
    for _ in range(MAX_DEPTH - 1):
        large = level.filter(F.col("size") > limit)
        if large.isEmpty():
            return leaves
        children = large.join(nodes.select("node", "signature"), "node").select("bucket", "node", "signature").mapInArrow(split, "bucket bigint, node binary")
        level = _shared(children.distinct(), "buckets")
        leaves = leaves.unionByName(level.filter(F.col("size") <= limit).select("bucket", F.lit(0).alias("part"), F.lit(2).alias("side"), "node"))
    large = level.filter(F.col("size") > limit).withColumn("blocks", F.ceil(F.col("size") / (limit / 2)).cast("int"))
    large = large.withColumn("own", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))
    other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        (F.least("own", k) * F.col("blocks") + F.greatest("own", k)).alias("part"), F.when(F.col("own") == k, 2).when(F.col("own") < k, 0).otherwise(1).alias("side"),
    ))
    blocks = large.select("bucket", "node", F.explode(other).alias("b")).select("bucket", (F.col("b.part") + 1).alias("part"), "b.side", "node")
    return leaves.unionByName(blocks)


def _runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Tables of whole groups (bucket, part), of rows sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        table = pa.Table.from_batches(held)
        b, q = table.column("bucket").to_numpy(), table.column("part").to_numpy()
        last = np.flatnonzero((b != b[-1]) | (q != q[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _sketch_bits(signatures: np.ndarray) -> np.ndarray:
    """Two bits of every coordinate, in four words."""
    two = np.empty((len(signatures), 2 * COORDINATES), np.uint8)
    two[:, ::2], two[:, 1::2] = signatures & 1, signatures >> 1 & 1
    return np.packbits(two, axis=1).view(np.uint64)


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Coordinates whose two bits differ."""
    x = a ^ b
    return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=-1, dtype=np.int64)


def _met_before(lists: list[set[int]], bucket: int) -> np.ndarray | None:
    """Of each pair of a large group: whether it shares a lesser bucket, too."""
    rows, keys = [], []
    for i, some in enumerate(lists):
        lesser = [k for k in some if k < bucket]
        rows += [i] * len(lesser)
        keys += lesser
    distinct, column, count = np.unique(np.array(keys, np.int64), return_inverse=True, return_counts=True)
    wanted = count > 1
    if not wanted.any():
        return None
    place, met = np.cumsum(wanted) - 1, np.zeros((len(lists), len(lists)), bool)
    rows, column = np.array(rows), column[:]
    for lo in range(0, int(wanted.sum()), 1024):
        take = wanted[column] & (place[column] >= lo) & (place[column] < lo + 1024)
        has = np.zeros((len(lists), 1024), np.float32)
        has[rows[take], place[column[take]] - lo] = 1
        met |= has @ has.T > 0
    return met


def candidates(members: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(bucket, part, node, partners): nodes with the later ones of their group that may be similar; partners have rows too."""
    differ = (1 - threshold) * 0.75  # how often two bits of a coordinate differ in a pair at the threshold
    most = COORDINATES * differ + DEVIATIONS * math.sqrt(COORDINATES * differ * (1 - differ))
    lists = members.groupBy("node").agg(F.sort_array(F.collect_set("bucket")).alias("all"))  # some tens for a node
    rows = members.join(lists, "node").join(nodes.select("node", "n", "bits"), "node")
    rows = rows.select("bucket", "part", "side", "node", "all", "n", "bits").repartition("bucket", "part").sortWithinPartitions("bucket", "part", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 2000):
            bucket, part, side, n = (table.column(c).to_numpy() for c in ("bucket", "part", "side", "n"))
            nodes_, lists_ = table.column("node").to_pylist(), [set(x) for x in table.column("all").to_pylist()]
            bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(n), 4)
            partners: list[list[bytes]] = [[] for _ in range(len(n))]
            needed = np.zeros(len(n), bool)
            cuts = np.concatenate(([0], np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])) + 1, [len(n)]))
            sizes = np.diff(cuts)

            def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                fits = (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9) & ((side[i] == 2) | (side[i] != side[j]))
                return fits & (_differing(bits[i], bits[j]) <= most)

            start = np.flatnonzero(np.repeat(sizes <= PAIRWISE, sizes))
            group = np.repeat(np.arange(len(sizes)), sizes)
            for d in range(1, PAIRWISE):
                start = start[start + d < len(n)]
                start = start[group[start + d] == group[start]]
                if not len(start):
                    break
                close = start[near(start, start + d)]
                for x, y in zip(close.tolist(), (close + d).tolist()):
                    if bucket[x] == min(lists_[x] & lists_[y]):
                        partners[x].append(nodes_[y])
                        needed[x] = needed[y] = True
            for g in np.flatnonzero(sizes > PAIRWISE).tolist():
                lo, hi = int(cuts[g]), int(cuts[g + 1])
                met = _met_before(lists_[lo:hi], int(bucket[lo]))
                for x in range(lo, hi - 1):
                    y = np.arange(x + 1, hi)
                    ok = near(np.full(len(y), x), y)
                    if met is not None:
                        ok &= ~met[x - lo, x + 1 - lo:]
                    y = y[ok]
                    if len(y):
                        partners[x] = [nodes_[k] for k in y.tolist()]
                        needed[x] = True
                        needed[y] = True
            at = np.flatnonzero(needed)
            yield pa.RecordBatch.from_arrays([
                pa.array(bucket[at]), pa.array(part[at]), pa.array([nodes_[x] for x in at], pa.binary()), pa.array([partners[x] for x in at], pa.list_(pa.binary())),
            ], names=["bucket", "part", "node", "partners"])

    return rows.mapInArrow(compare, "bucket bigint, part int, node binary, partners array<binary>")


def _shared_sizes(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets; pair by pair, or for a dense group by a product of its 0-1 matrix."""
    m = len(sets)
    columns = None
    if len(i) > 16 * m:
        distinct, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        columns = int((count > 1).sum())
    if columns is None or 2e-10 * m * m * columns > 3e-5 * len(i):
        out = np.zeros(len(i), np.int64)
        for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
            small, big = sorted((sets[x], sets[y]), key=len)
            at = np.minimum(np.searchsorted(big, small), len(big) - 1)
            out[k] = np.count_nonzero(big[at] == small)
        return out
    row, place = np.repeat(np.arange(m), [len(s) for s in sets]), np.cumsum(count > 1) - 1
    row, column = row[count[column] > 1], place[column[count[column] > 1]]
    out = np.zeros(len(i), np.float64)
    for lo in range(0, columns, 1024):
        take = (column >= lo) & (column < lo + 1024)
        has = np.zeros((m, 1024), np.float32)
        has[row[take], column[take] - lo] = 1
        both = has @ has.T
        out += both[i, j]
    return np.rint(out).astype(np.int64)


def verified(found: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """(node, root, links): verified links of each node in each group, and its root in the group's forest.

    ``texts`` has a text for each node that occurs in ``found``.
    """
    rows = found.join(texts, "node").select("bucket", "part", "node", "partners", "text").repartition("bucket", "part").sortWithinPartitions("bucket", "part", "node")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for table in _runs(batches, 500):
            bucket, part, nodes_ = table.column("bucket").to_numpy(), table.column("part").to_numpy(), table.column("node").to_pylist()
            partners = table.column("partners").to_pylist()
            sets: list[np.ndarray] = []
            for _, _, data, offsets in text_slices(table.column("text").chunk(0), SLICE_BYTES):
                sets += shingle_sets(*hasher.words(data, offsets), words)
            cuts = np.concatenate(([0], np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])) + 1, [len(bucket)])).tolist()
            links, root = np.zeros(len(nodes_), np.int64), list(range(len(nodes_)))

            def top(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for lo, hi in zip(cuts, cuts[1:]):
                place = {x: k for k, x in enumerate(nodes_[lo:hi])}
                i = np.array([k for k in range(hi - lo) for _ in partners[lo + k]], np.int64)
                j = np.array([place[x] for k in range(lo, hi) for x in partners[k]], np.int64)
                size = np.array([len(s) for s in sets[lo:hi]])
                both = _shared_sizes(sets[lo:hi], i, j)
                good = both >= threshold * (size[i] + size[j] - both) - 1e-9
                i, j = i[good] + lo, j[good] + lo
                links += np.bincount(np.concatenate((i, j)), minlength=len(links))
                for x, y in zip(i.tolist(), j.tolist()):
                    x, y = top(x), top(y)
                    if x != y:
                        root[max(x, y)] = min(x, y)
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([
                pa.array([nodes_[i] for i in at], pa.binary()), pa.array([nodes_[top(int(i))] for i in at], pa.binary()), pa.array(links[at]),
            ], names=["node", "root", "links"])

    return rows.mapInArrow(check, "node binary, root binary, links bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the edges (a, b), by contracting neighbourhoods until no edge is left."""
    edges = written(edges.filter("a <> b").select("a", "b"), "edges")
    out = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "roots")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "steps")
        step = written(least.alias("s").join(least.alias("t"), F.col("s.m") == F.col("t.a")).select(F.col("s.a").alias("a"), F.col("t.m").alias("m")), "steps")
        out = written(out.join(step, out["root"] == step["a"], "left").select("node", F.coalesce("m", "root").alias("root")), "roots")
        one = edges.join(step, "a").select(F.col("m").alias("x"), "b")
        edges = written(one.join(step, one["b"] == step["a"]).select(F.col("x").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "edges")
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, limit: int = LIMIT) -> DataFrame:
    """doc_id, class_id, n_links, n_copies of every row.

    class_id: least id of the texts that links join; n_links: different texts (sets) that are similar to this one;
    n_copies: rows with the same set, this one among them.
    """
    return _classes(docs, doc_id, text, words, threshold, recall, limit).select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_copies")


def _classes(docs: DataFrame, doc_id: str, text: str, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, limit: int = LIMIT) -> DataFrame:
    """id, text_hash, class_id, n_links, n_copies of every row."""
    rows = written(sketches(docs, doc_id, text, words, threshold, runs_for(recall, threshold)), "sketches")
    nodes = rows.groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("bits").alias("bits"), F.first("keys").alias("keys"))
    nodes = written(nodes, "nodes")
    members = written(buckets(nodes.filter("n > 0"), threshold, limit), "members")
    found = written(candidates(members, nodes, threshold), "candidates")
    wanted = written(found.select("node").distinct().join(nodes.select("node", "id"), "node"), "wanted")
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    same = texts["id"].eqNullSafe(wanted["id"])
    texts = texts.join(wanted.hint("merge"), same).select("node", "text")  # one plan at every size
    checked = written(verified(found, _own_texts(texts, words), words, threshold), "links")
    roots = components(checked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = checked.groupBy("node").agg(F.sum("links").alias("n_links"))
    placed = nodes.select("node", "id", "copies").join(roots, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = written(placed, "placed-nodes")
    classes = placed.groupBy("root").agg(F.min("id").alias("class_id"))
    by_node = placed.join(classes, "root").select("node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("copies").alias("n_copies"))
    return rows.select("id", "text_hash", "node").join(by_node, "node").select("id", "text_hash", "class_id", "n_links", "n_copies")


def _own_texts(texts: DataFrame, words: int) -> DataFrame:
    """One text for each node: an id may have rows with other texts, and a text repeated rows."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            nodes_ = batch.column("node").to_pylist()
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                sets = shingle_sets(*hasher.words(data, offsets), words)
                keep[lo:hi] = [bool(len(s)) and _node(s, "") == x for s, x in zip(sets, nodes_[lo:hi])]
            yield batch.filter(pa.array(keep))

    return texts.mapInArrow(own, "node binary, text string").dropDuplicates(["node"])


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with the row of the least id of every class only. Rows without an id always stay. A document is an id and a
    text; of its repeated rows the one of the least hash of all columns stays."""
    of, hashed, key, nth = free_names(docs, "gone_id", "gone_hash", "text_key", "nth")
    classes = _classes(docs, doc_id, text, **how)
    gone = written(classes.filter("id <> class_id").select(F.col("id").alias(of), F.col("text_hash").alias(hashed)).distinct(), "duplicates")
    same = (F.col(doc_id) == F.col(of)) & (F.col(key) == F.col(hashed))
    left = docs.withColumn(key, F.xxhash64(text)).join(gone.hint("merge"), same, "left_anti")
    # maps have no hash and no order: rows that differ in them alone are equal here
    rest = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    first = F.row_number().over(Window.partitionBy(doc_id, key).orderBy(F.xxhash64(*rest)))
    return left.withColumn(nth, first).filter((F.col(nth) == 1) | F.col(doc_id).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
