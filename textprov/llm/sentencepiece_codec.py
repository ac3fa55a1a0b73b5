"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed here; from it come the normaliser (character map, dummy prefix, extra white space),
the marker for spaces, the unigram scores or the merges implied by the scores of a pair-encoding model, byte fallback
and the decoder. Batches are encoded by the library's threads. A text is encoded chunk by chunk where no piece can cross
the start of a chunk. ``verify`` compares the ids with the SentencePiece library's own, row by row.

Defined cases: null and empty texts have no ids and decode to the empty text. Columns other than the named ones are
ignored. Texts of any length are encoded whole.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe_memo import ChunkMemo, chunk_encoder, worker_memo
from .common import text_lists

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CALL_BYTES = 1 << 20
THREADS = 2


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = 1  # 1 unigram, 2 pair encoding
    byte_fallback: bool = False
    character_map: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message."""
    at, end = 0, len(data)

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < end:
        key = number()
        kind = key & 7
        if kind == 0:
            value: int | bytes = number()
        else:
            size = {1: 8, 5: 4}[kind] if kind != 2 else number()
            value = data[at:at + size]
            at += size
        yield key >> 3, value


def parse_model(data: bytes) -> PieceModel:
    """A model file: pieces (field 1), trainer settings (2), normaliser settings (3)."""
    model = PieceModel()
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL, **dict(_fields(value))}
            model.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            settings = dict(_fields(value))
            model.kind, model.byte_fallback = settings.get(3, 1), bool(settings.get(35, 0))
            if settings.get(24, 0):
                raise ValueError("models with the marker at word ends are not read")
        elif number == 3:
            settings = dict(_fields(value))
            model.character_map, model.dummy_prefix = settings.get(2, b""), bool(settings.get(3, 1))
            model.remove_extra, model.escape = bool(settings.get(4, 1)), bool(settings.get(5, 1))
    if model.kind not in (1, 2):
        raise ValueError("the model is neither unigram nor pair encoding")
    return model


def _merges(model: PieceModel) -> list[tuple[str, str]]:
    """All ways to join two pieces to a third, best score first, as the scores stand for the order of merges."""
    ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
    found = []
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in ids and right in ids:
                found.append((-model.pieces[i][1], i, ids[left], ids[right], left, right))
    return [(f[4], f[5]) for f in sorted(found)]


def build(model: PieceModel):
    """(tokenizer, whether its chunks start at every marker that follows another character)."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
    if model.kind == 1:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
    else:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, _merges(model), unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.character_map)] if model.character_map else []
    if model.remove_extra:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    split = not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER))
    if split:
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    user = [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER]
    if user:
        tokenizer.add_tokens(user)
    tail = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return tokenizer, split and not user


class Codec:
    """Encoder and decoder of a model file, for one Python worker."""

    def __init__(self, path: str, threads: int = THREADS) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        with open(path, "rb") as f:
            model = parse_model(f.read())
        self.tokenizer, split = build(model)
        self.memo = None
        if split:
            normalizer, self.tokenizer.normalizer = self.tokenizer.normalizer, None
            self.normalize = normalizer.normalize_str
            begins = np.array([p.startswith(MARK) for p, _, _ in model.pieces])
            encode = chunk_encoder(self.tokenizer, begins, lambda c: len(c) > 1 and c[0] == MARK != c[1])
            self.memo = ChunkMemo(encode, MARK)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.memo is None:
            return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        rows = [(self.normalize(t) if t else "").encode() for t in texts]
        ids, cuts = self.memo.encode(np.frombuffer(b"".join(rows), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in rows], dtype=np.int64))))
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


def codec(path: str, threads: int = THREADS) -> Codec:
    return worker_memo(("sentencepiece", path), lambda: Codec(path, threads))


def _library(path: str):
    import sentencepiece

    return worker_memo(("sentencepiece library", path), lambda: sentencepiece.SentencePieceProcessor(model_file=path))


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", threads: int = THREADS, verify: bool = False, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), ids, and with ``verify`` also
    ``round_trip`` (the ids decode to the text) and ``parity`` (they are those of the SentencePiece library).

    ``path`` is a model file that every executor can open.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    more = ["ids array<int>"] * keep_ids + ["round_trip boolean", "parity boolean"] * verify
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(", ".join(["n_tokens bigint", "ids_crc32 bigint", *more])).fields])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, threads)
        for batch in batches:
            for lo, hi, part in text_lists(batch.column("text"), CALL_BYTES):
                ids = own.encode(part)
                out = [batch.column("doc_id").slice(lo, hi - lo), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                if keep_ids:
                    cuts = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                    out.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32))))
                if verify:
                    out.append(pa.array([a == b for a, b in zip(own.decode(ids), part)], pa.bool_()))
                    out.append(pa.array([a.tolist() == b for a, b in zip(ids, _library(path).encode(part, num_threads=1))], pa.bool_()))
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema])

    return docs.mapInArrow(encode, schema)


def decoded(rows: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids", threads: int = THREADS) -> DataFrame:
    """doc_id, text of rows with lists of ids; a null list is an empty one."""
    rows = rows.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, threads)
        for batch in batches:
            lists = [np.array(x, np.int64) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.decode(lists), pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(decode, T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType())]))
