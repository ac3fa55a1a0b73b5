"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over the symbols of a text, after ``order - 1`` marks for its start. A symbol is a word (a run of letters and
digits), a character of a script that is written without spaces, or a mark other than white space; or,
with the unit ``BYTES``, a UTF-8 byte. N-grams are known by 64-bit hashes. Keys travel sorted, in
compressed blocks for shards, which are ranges of keys. Training counts, continuation counts and the classes of contexts'
counts are made in the shards and lie in a bucketed table, so that no join moves the model. Documents are dealt into chunks of
bounded size. A chunk asks for each of its distinct n-grams of all orders once; requests meet the model in the n-gram's shard, and
what the model knows of goes back to the chunk, where probabilities are made and added up per document. No model is sent
to all tasks.

All this takes several times the room of the texts, so it comes in turns: n-grams are counted by parts of their keys, documents
are scored by parts of their hashes. Shuffle files and tables of a turn are removed when it has ended.

Thresholds are quantiles of perplexity, one for each language, over trusted documents that did not train the model.

Defined cases: null and empty texts, and those without symbols, have no perplexity and are not kept. A null language is a language. A language with
fewer than ``least_held`` held-out documents gets the quantile of all languages; without any held-out document every text
with a perplexity is kept. Without trusted text all symbols are equally likely. Trust in ids that are null or unknown has
no effect. Rows of one id are judged row by row. Other columns are ignored.

``docs`` is read once for its size, once for the texts that train and once for each turn, and has to give the same rows then, in any
order and partitions. The rows of a turn, their trust and the number of their chunk are written before n-grams are asked for.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Hasher, mixed, scratch_path, text_lengths

#: Units of the model, and orders that fit them.
WORDS, BYTES = "words", "bytes"
WORD_ORDER, ORDER = 3, 4
QUANTILE = 0.99
LEAST_HELD = 100
#: Bytes of text in a chunk (one longer text is a chunk of its own).
CHUNK_BYTES = 8 << 20
#: Bytes of text whose n-grams are counted at once.
SLICE_BYTES = 1 << 20
COUNT_BYTES = 8 << 20
#: Bytes of all texts for a shard of the model; buckets of shards in its table, at most.
SHARD_BYTES, BUCKETS = 16 << 20, 256
#: Documents are scored in so many turns at most, of so many bytes at least; n-grams are counted in so many.
TURNS, TURN_BYTES, COUNT_TURNS = 16, 8 << 20, 2
_MODEL_NAMES = ["shard", "what", "keys", "numbers", "seen"]
_MODEL = "shard bigint, what string, keys binary, numbers binary, seen array<bigint>"
_ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _words(texts: list[bytes], hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets of the texts into them)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # characters
    lead, second = data[at], data[np.minimum(at + 1, len(data) - 1)]
    alone = (lead >= 0xE2) | (lead == 0xC2) | ((lead == 0xE0) & (second >= 0xB8) & (second <= 0xBB))  # East Asia and marks; Thai and Lao
    alone |= (lead == 0xE1) & ((second <= 0x82) | (second == 0x9E) | (second == 0x9F))  # Burmese, Khmer
    alone |= (lead < 128) & ~_ALNUM[lead] & (lead > 32) & (lead != 127)
    word = ~alone & (_ALNUM[lead] | (lead >= 128))
    new = np.zeros(len(at) + 1, bool)  # the first character of a text
    new[0] = new[-1] = True
    new[np.searchsorted(at, ends)] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | new[1:-1]
    last[:-1] &= ~word[1:] | new[1:-1]
    starts = at[first | alone]
    stops = np.append(at[1:], len(data))[last | alone]
    return hasher.spans(data, starts, stops), np.searchsorted(starts, np.concatenate(([0], ends)))


def _bytes(texts: list[bytes], _: Hasher) -> tuple[np.ndarray, np.ndarray]:
    symbols = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
    return symbols, np.cumsum([0, *[len(t) for t in texts]])


_SYMBOLS = {WORDS: _words, BYTES: _bytes}


def _grams(symbols: np.ndarray, offsets: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(n-grams of the orders 1 to ``order`` that end at each symbol, the contexts of those from order 2)."""
    pad, lengths = order - 1, np.diff(offsets)
    padded = np.zeros(int(lengths.sum()) + pad * len(lengths), np.uint64)
    starts = np.cumsum(lengths + pad) - lengths
    inside = np.ones(len(padded), bool)
    for k in range(pad):
        inside[starts - 1 - k] = False
    padded[inside] = symbols
    every = [mixed(padded + _STEP)]
    for k in range(2, order + 1):
        every.append(np.zeros_like(padded))
        every[-1][1:] = mixed(every[-2][:-1] * _STEP + padded[1:] + np.uint64(k))
    before = np.flatnonzero(inside) - 1
    return [g[inside].view(np.int64) for g in every], [g[before].view(np.int64) for g in every[:-1]]


def dealt(docs: DataFrame, trusted: DataFrame, doc_id: str, text: str, lang: str, chunk_bytes: int) -> DataFrame:
    """part, id, lang, trains (null: not trusted), packed (text) of every row.

    ``trusted`` has ``id`` and ``trains``, an id once. It is one join at every size; ``part`` is the number of the chunk.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    id_field = T.StructField("id", rows.schema["id"].dataType)
    small = T.StructType([id_field, *T._parse_datatype_string("lang string, n bigint, packed binary").fields])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tool = zstandard.ZstdCompressor(level=1)
        for b in batches:
            texts = [tool.compress((t or "").encode()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), pa.array(text_lengths(b.column("text"))), pa.array(texts, pa.binary())], names=small.names)

    packed = rows.mapInArrow(pack, small).withColumn("salt", F.when(F.col("id").isNull(), F.xxhash64("packed")).otherwise(F.lit(0)))  # null ids lie anywhere
    joined = packed.join(trusted.withColumn("salt", F.lit(0).cast("bigint")).hint("merge"), ["id", "salt"], "left").select("id", "lang", "trains", "n", "packed")
    numbered = T.StructType([T.StructField("part", T.LongType()), id_field, *T._parse_datatype_string("lang string, trains boolean, packed binary").fields])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            parts = np.zeros(b.num_rows, np.int64)
            for i, n in enumerate(b.column("n").to_numpy().tolist()):
                if total and total + n > chunk_bytes:
                    part, total = part + 1, 0
                total += n
                parts[i] = part
            yield pa.RecordBatch.from_arrays([pa.array(parts), *[b.column(c) for c in numbered.names[1:]]], names=numbered.names)

    return joined.mapInArrow(number, numbered)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(chunk number, its rows)."""
    held, number = [], None
    for batch in batches:
        parts = batch.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)] if len(parts) else []
        for lo, hi in zip(cuts, cuts[1:]):
            if held and parts[lo] != number:
                yield number, held
                held = []
            number = int(parts[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield number, held


def _text_slices(packed: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end row, texts): the n-grams of a chunk are never held all at once."""
    import zstandard

    tool, lo, size, texts = zstandard.ZstdDecompressor(), 0, 0, []
    for i, one in enumerate(packed.to_pylist()):
        texts.append(tool.decompress(one))
        size += len(texts[-1])
        if size > slice_bytes or i + 1 == len(packed):
            yield lo, i + 1, texts
            lo, size, texts = i + 1, 0, []


def _shards(keys: np.ndarray, n: int) -> np.ndarray:
    """The shard of every key: ranges of keys, so that sorted keys lie shard by shard."""
    return (((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _pack(numbers: np.ndarray, ascending: bool = False) -> bytes:
    """64-bit numbers as compressed planes of bytes, those of ascending ones as steps."""
    import zstandard

    numbers = np.diff(numbers, prepend=np.uint64(0)) if ascending else numbers
    width = np.min_scalar_type(int(numbers.max())).itemsize if len(numbers) else 1
    planes = np.ascontiguousarray(numbers.astype(f"u{width}").view(np.uint8).reshape(len(numbers), width).T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(packed: bytes, ascending: bool = False) -> np.ndarray:
    import zstandard

    width, planes = packed[0], np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), np.uint8)
    numbers = np.ascontiguousarray(planes.reshape(width, len(planes) // width).T).view(f"u{width}").ravel().astype(np.uint64)
    return np.cumsum(numbers, dtype=np.uint64) if ascending else numbers


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Different keys, ascending: sorted, as hash tables (``np.unique``) take ten times as long."""
    keys = np.sort(keys)
    return keys[_firsts(keys)]


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Places where sorted keys change."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def _places(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys in sorted ones; the place behind the last for those not there. Keys are looked up in ascending order."""
    by = np.argsort(keys)
    keys, out = keys[by], np.empty(len(keys), np.int64)
    at = np.searchsorted(held, keys)
    if len(held):
        at[held[np.minimum(at, len(held) - 1)] != keys] = len(held)
    out[by] = at
    return out


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _classes(of: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, 4 rows: counts of 1, of 2, higher ones, and their sum) of sorted keys that repeat."""
    at = _firsts(of)
    return of[at], np.array([np.add.reduceat(x.astype(np.uint64), at) for x in (counts == 1, counts == 2, counts > 2, counts)]) if len(at) else np.zeros((4, 0), np.uint64)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a job go when the job has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def training_texts(docs: DataFrame, trusted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """packed: the texts that train."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tool = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([tool.compress((t or "").encode()) for t in b.column("text").to_pylist()], pa.binary())], names=["id", "packed"])

    packed = rows.mapInArrow(pack, T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("packed", T.BinaryType())]))
    return packed.join(trusted.filter("trains").select("id").hint("merge"), "id").select("packed")


def training_counts(texts: DataFrame, order: int, unit: str, n_shards: int, level: int, contexts_of_it: bool, turn: int, turns: int) -> DataFrame:
    """shard, what, keys, numbers, seen of the keys of one turn, packed.

    ``gram``: n-grams of ``level`` and their counts, which below ``order`` are those of the symbols before them; ``seen`` has
    how many counts are 1, 2, 3 and 4, all counts, and their sum. ``part``: the contexts of the n-grams of a shard and the
    classes of their counts. ``context`` (with ``contexts_of_it``, at ``order``): contexts and the classes of all their n-grams.
    """
    carries = 1 < level < order  # n-grams take their contexts along
    single = level == order and not contexts_of_it  # an n-gram is its own key

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for _, _, texts in _text_slices(batch.column("packed"), COUNT_BYTES):
                grams, contexts = _grams(*_SYMBOLS[unit](texts, hasher), order)
                home = (contexts[-1] if contexts_of_it else grams[level - 1]).view(np.uint64)
                mine = np.flatnonzero(home % np.uint64(turns) == turn)
                if not len(mine):
                    continue
                item = grams[min(level, order - 1)].view(np.uint64)[mine]
                by = np.argsort(item)
                at = _firsts(item[by])
                c, at = np.diff(np.append(at, len(by))).astype(np.uint64), by[at]
                by = np.argsort(home[mine[at]])
                item, at, c = item[at[by]], mine[at[by]], c[by]
                keys = home[at]
                cuts = np.searchsorted(_shards(keys, n_shards), np.arange(n_shards + 1))
                of = contexts[level - 2].view(np.uint64)[at] if carries else None
                for shard in np.flatnonzero(np.diff(cuts)).tolist():
                    own = slice(cuts[shard], cuts[shard + 1])
                    row = [shard], [_pack(keys[own], True)], [None if single else _pack(item[own])], [_pack(of[own][_firsts(keys[own])]) if carries else None], [_pack(c[own])]
                    yield pa.RecordBatch.from_arrays([pa.array(row[0]), *[pa.array(x, pa.binary()) for x in row[1:]]], names=["shard", "keys", "items", "of", "c"])

    told = texts.mapInArrow(tell, "shard bigint, keys binary, items binary, of binary, c binary")

    def gather(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [_unpack(r["keys"], True) for r in rows]
        keys, c = _joined(parts), _joined([_unpack(r["c"]) for r in rows])
        items = keys if single else _joined([_unpack(r["items"]) for r in rows])
        of = _joined([np.repeat(_unpack(r["of"]), np.diff(np.append(_firsts(k), len(k)))) for r, k in zip(rows, parts)]) if carries else None
        by = np.argsort(items)
        at = _firsts(items[by])  # an item has one key
        c, keys, of = np.add.reduceat(c[by], at), keys[by][at], of[by][at] if carries else None
        by = np.argsort(keys)
        keys, c, of = keys[by], c[by], of[by] if carries else None
        if contexts_of_it:
            out = [("context", *_classes(keys, c), None)]
        else:
            at = _firsts(keys)
            if not single:
                c = np.diff(np.append(at, len(keys))).astype(np.uint64)
            keys, of = keys[at], of[at] if carries else None
            out = [("gram", keys, c[None], [int((c == k).sum()) for k in (1, 2, 3, 4)] + [len(c), int(c.sum())])]
            if carries:
                by = np.argsort(of)
                out.append(("part", *_classes(of[by], c[by]), None))
        shard = rows[0]["shard"]
        return pa.table([pa.array([shard] * len(out)), pa.array([w for w, *_ in out]), pa.array([_pack(k, True) for _, k, *_ in out], pa.binary()), pa.array([_pack(n.ravel()) for _, _, n, _ in out], pa.binary()), pa.array([x for *_, x in out], pa.list_(pa.int64()))], names=_MODEL_NAMES)

    return told.groupBy("shard").applyInArrow(gather, _MODEL)


def whole_contexts(parts: DataFrame, n_shards: int) -> DataFrame:
    """``part`` rows of all shards as ``context`` rows."""
    names = ["one", "two", "more", "total"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n in zip(batch.column("keys").to_pylist(), batch.column("numbers").to_pylist()):
                keys, numbers = _unpack(k, True), _unpack(n)
                numbers = numbers.reshape(4, len(keys))
                for a in range(0, len(keys), 1 << 16):
                    own = slice(a, a + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(_shards(keys[own], n_shards)), *[pa.array(x[own].view(np.int64)) for x in (keys, *numbers)]], names=["shard", "key", *names])

    def pack(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy().view(np.uint64)
        by = np.argsort(keys)
        numbers = np.concatenate([table.column(c).to_numpy()[by].view(np.uint64) for c in names])
        return pa.table([table.column("shard")[:1].combine_chunks(), pa.array(["context"]), pa.array([_pack(keys[by], True)], pa.binary()), pa.array([_pack(numbers)], pa.binary()), pa.array([None], pa.list_(pa.int64()))], names=_MODEL_NAMES)

    exploded = parts.select("keys", "numbers").mapInArrow(rows, "shard bigint, key bigint, one bigint, two bigint, more bigint, total bigint")
    return exploded.groupBy("shard", "key").agg(*[F.sum(c).alias(c) for c in names]).groupBy("shard").applyInArrow(pack, _MODEL)


def _discounts(ones: list[int]) -> list[float]:
    """For n-grams seen once, twice and more often, from the counts of counts."""
    n = [0, *ones]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    return [min(float(k), max(0.05, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else 0.5 * k for k in (1, 2, 3)]


def _save(rows: DataFrame, name: str, n_shards: int) -> None:
    """Model rows added to a table that lies in buckets of shards, so that no join moves it."""
    rows.write.mode("append").format("parquet").bucketBy(min(n_shards, BUCKETS), "shard").saveAsTable(name)


def model(texts: DataFrame, order: int, unit: str, n_shards: int, turns: int, name: str) -> tuple[DataFrame, list[list[int]]]:
    """(``gram`` and ``context`` rows, as the table ``name``; of every level: counts of 1, 2, 3 and 4, all counts, and their sum).

    Levels are counted one after the other, and one part of their keys after the other (``turns``), as what is moved for all
    takes several times the room of the model.
    """
    spark, seen = texts.sparkSession, []
    for level in range(1, order + 1):
        carries, own_turns = 1 < level < order, turns if level > 1 else 1
        to = f"{name}_level" if carries else name
        for turn in range(own_turns):
            _save(training_counts(texts, order, unit, n_shards, level, False, turn, own_turns).withColumn("level", F.lit(level)), to, n_shards)
        if carries:
            found = spark.table(to)
            _save(found.filter("what = 'gram'"), name, n_shards)
            _save(whole_contexts(found.filter("what = 'part'"), n_shards).withColumn("level", F.lit(level)), name, n_shards)
            spark.sql(f"DROP TABLE {to}")
        row = spark.table(name).filter(f"what = 'gram' and level = {level}").agg(*[F.coalesce(F.sum(F.col("seen")[k]), F.lit(0)) for k in range(6)]).first()
        seen.append([int(x) for x in row])
    for turn in range(2 * turns):  # most of the model lies there by now
        _save(training_counts(texts, order, unit, n_shards, order, True, turn, 2 * turns).withColumn("level", F.lit(order)), name, n_shards)
    return spark.table(name), seen


def requests(chunks: DataFrame, order: int, unit: str, n_shards: int) -> DataFrame:
    """part, shard, keys: the distinct n-grams and contexts of every chunk. A chunk that two tasks read asks twice."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for part, held in _chunks(batches):
            parts = [np.zeros(0, np.uint64)]
            for b in held:
                for _, _, texts in _text_slices(b.column("packed")):
                    grams, contexts = _grams(*_SYMBOLS[unit](texts, hasher), order)
                    parts.append(_distinct(np.concatenate(grams + contexts).view(np.uint64)))
            distinct = _distinct(np.concatenate(parts))
            cuts = np.searchsorted(_shards(distinct, n_shards), np.arange(n_shards + 1))
            for shard in np.flatnonzero(np.diff(cuts)).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([shard]), pa.array([_pack(distinct[cuts[shard]:cuts[shard + 1]], True)], pa.binary())], names=["part", "shard", "keys"])

    return chunks.select("part", "packed").mapInArrow(ask, "part bigint, shard bigint, keys binary")


def answers(asked: DataFrame, known: DataFrame) -> DataFrame:
    """part, keys, numbers (5 for each key: the n-gram's count, the classes of the context) of what the model knows."""

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for what, n in (("gram", 1), ("context", 4)):
            held = [(_unpack(k, True), _unpack(v)) for w, k, v in zip(*[right.column(c).to_pylist() for c in ("what", "keys", "numbers")]) if w == what]
            keys = _joined([k for k, _ in held])
            by = np.argsort(keys)
            numbers = np.concatenate([v.reshape(n, len(k)) for k, v in held], 1)[:, by] if held else np.zeros((n, 0), np.uint64)
            tables.append((keys[by], np.append(numbers, np.zeros((n, 1), np.uint64), 1)))
        out = [[], [], []]
        for part, packed in zip(left.column("part").to_pylist(), left.column("keys").to_pylist()):
            keys = _unpack(packed, True)
            places = [_places(held, keys) for held, _ in tables]
            known = np.flatnonzero((places[0] < len(tables[0][0])) | (places[1] < len(tables[1][0])))
            if len(known):
                rows = np.concatenate([numbers[:, at[known]] for at, (_, numbers) in zip(places, tables)])
                for x, y in zip(out, (part, _pack(keys[known], True), _pack(rows.ravel()))):
                    x.append(y)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["part", "keys", "numbers"])

    return asked.groupBy("shard").cogroup(known.select("shard", "what", "keys", "numbers").groupBy("shard")).applyInArrow(look_up, "part bigint, keys binary, numbers binary")


def perplexities(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER, chunk_bytes: int = CHUNK_BYTES, unit: str = BYTES, turn_bytes: int = TURN_BYTES) -> DataFrame:
    """id, lang, trains, n_bytes, perplexity (per symbol) of every document, as a written table.

    ``trusted``: id of the trusted documents, and ``trains``, false for those that are held out. Documents are scored in turns
    (up to ``TURNS``, of ``turn_bytes`` or more), by a hash of id and text.
    """
    if not 2 <= order <= 7:
        raise ValueError("order is 2 to 7")
    spark = docs.sparkSession
    trusted = trusted.filter("id is not null").groupBy("id").agg(F.min("trains").alias("trains"))
    n_bytes = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    n_shards, turns = int(n_bytes // SHARD_BYTES) + 1, int(min(TURNS, n_bytes // turn_bytes + 1))
    name, path = f"kneser_ney_{uuid.uuid4().hex}", scratch_path(spark, "scored")
    try:
        with _shuffles_removed(spark):
            training_texts(docs, trusted, doc_id, text).write.format("parquet").saveAsTable(f"{name}_texts")
            known, seen = model(spark.table(f"{name}_texts"), order, unit, n_shards, min(turns, COUNT_TURNS), name)
            spark.sql(f"DROP TABLE {name}_texts")
            for turn in range(turns):
                rows = docs.filter(F.pmod(F.xxhash64(doc_id, text), F.lit(turns)) == turn) if turns > 1 else docs
                dealt(rows, trusted, doc_id, text, lang, chunk_bytes).write.format("parquet").saveAsTable(f"{name}_chunks")
                scored = _scored(spark.table(f"{name}_chunks"), known, seen, order, unit, n_shards)
                scored.write.mode("append").parquet(path)
                spark.sql(f"DROP TABLE {name}_chunks")
            return spark.read.schema(scored.schema).parquet(path)
    finally:
        for own in ("_texts", "_level", "_chunks", ""):
            spark.sql(f"DROP TABLE IF EXISTS {name}{own}")


def _scored(chunks: DataFrame, known: DataFrame, seen: list[list[int]], order: int, unit: str, n_shards: int) -> DataFrame:
    cuts = [np.array(_discounts(s[:4])) for s in seen]
    n1, n2, _, _, n_symbols, total = seen[0]
    spared = float(np.dot((n1, n2, n_symbols - n1 - n2), cuts[0]))
    base = -8.0 if unit == BYTES else -float(np.log2(n_symbols + 1))  # all words that training has not seen are one symbol
    found = answers(requests(chunks, order, unit, n_shards), known)
    scored = T.StructType([chunks.schema["id"], *T._parse_datatype_string("lang string, trains boolean, n_bytes bigint, perplexity double").fields])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        held = [(_unpack(k, True), _unpack(v)) for k, v in zip(right.column("keys").to_pylist(), right.column("numbers").to_pylist())]
        key = _joined([k for k, _ in held])
        by_key = np.argsort(key)
        numbers = np.concatenate([v.reshape(5, len(k)) for k, v in held], 1) if held else np.zeros((5, 0))
        key, numbers = key[by_key], np.append(numbers.T[by_key].astype(np.float64), np.zeros((1, 5)), 0)  # the last row is that of unknown keys

        def own(gram: np.ndarray, cut: np.ndarray) -> np.ndarray:
            c = numbers[_places(key, gram.view(np.uint64)), 0]
            return np.maximum(c - np.where(c == 1, cut[0], np.where(c == 2, cut[1], cut[2])), 0.0)

        hasher, sums, lengths, sizes = Hasher(), [], [], []
        for _, _, texts in _text_slices(left.column("packed")):
            symbols, offsets = _SYMBOLS[unit](texts, hasher)
            grams, contexts = _grams(symbols, offsets, order)
            bits = np.full(len(symbols), base)
            with np.errstate(invalid="ignore", divide="ignore"):
                if total:
                    bits = np.logaddexp2(np.log2(own(grams[0], cuts[0]) / total), np.log2(spared / total) + bits)
                for gram, context, cut in zip(grams[1:], contexts, cuts[1:]):
                    one, two, more, totals = numbers[_places(key, context.view(np.uint64))].T[1:]
                    spares = one * cut[0] + two * cut[1] + more * cut[2]
                    bits = np.where(totals > 0, np.logaddexp2(np.log2(own(gram, cut) / totals), np.log2(spares / totals) + bits), bits)
            upto = np.concatenate(([0.0], np.cumsum(bits)))
            sums.append(upto[offsets[1:]] - upto[offsets[:-1]])
            lengths.append(np.diff(offsets))
            sizes.append(np.array([len(t) for t in texts], np.int64))
        n, bits, sizes = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lengths, sums, sizes)]
        perplexity = np.where(n > 0, 2.0 ** (-bits / np.maximum(n, 1)), np.nan)
        return pa.table([left.column("id"), left.column("lang"), left.column("trains"), pa.array(sizes), pa.array(perplexity, from_pandas=True)], names=scored.names)

    return chunks.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(score, scored)


def thresholds(scored: DataFrame, quantile: float = QUANTILE, least_held: int = LEAST_HELD) -> DataFrame:
    """lang, threshold: perplexity quantiles of held-out trusted documents."""
    held = scored.filter("trains = false and perplexity is not null")
    cut = F.percentile_approx("perplexity", quantile, 100_000)
    everything = held.agg(cut).first()[0]
    by_lang = held.groupBy("lang").agg(cut.alias("own"), F.count(F.lit(1)).alias("n"))
    fall_back = F.lit(float("inf") if everything is None else float(everything))
    return scored.select("lang").distinct().alias("a").join(by_lang.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang")), "left").select(
        "a.lang", F.when(F.col("n") >= least_held, F.col("own")).otherwise(fall_back).alias("threshold"),
    )


def classified(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER, quantile: float = QUANTILE, least_held: int = LEAST_HELD, unit: str = BYTES) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold, keep of every document."""
    scored = perplexities(docs, trusted, doc_id, text, lang, order, unit=unit)
    limits = thresholds(scored, quantile, least_held)
    rows = scored.alias("s").join(limits.alias("t"), F.col("s.lang").eqNullSafe(F.col("t.lang")))
    keep = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False))
    return rows.select(F.col("id").alias("doc_id"), F.col("s.lang").alias("lang"), "n_bytes", "perplexity", "threshold", keep.alias("keep"))


def trust(labels: DataFrame, label_id: str, good: Column, folds: int = 5) -> DataFrame:
    """Trusted ids of a label table; one fold of ``folds``, by the hash of the id, is held out."""
    return labels.filter(good).select(F.col(label_id).alias("id"), (F.crc32(F.col(label_id).cast("string").cast("binary")) % folds != 0).alias("trains"))
