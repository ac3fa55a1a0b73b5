"""Token ids of whole texts through the tokenizers library, one call for each distinct chunk instead of each text.

A chunk is a run of white space and the run of other characters after it. The two kinds of tokenizer served here never
join text across the start of a chunk, so the ids of a text are the ids of its chunks, one after another. Chunks recur,
so a worker keeps their ids in a table of bounded size.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa

from .common import Hasher

#: So many chunks are kept by a worker in each of two generations; chunks in use move to the younger one.
KEPT_CHUNKS = 300_000

#: White space as the tokenizers library's regular expressions see it (not Python's, which adds four control characters).
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class Marks:
    """Which bytes of a UTF-8 text belong to one of some characters."""

    def __init__(self, characters: str) -> None:
        encoded = [c.encode() for c in characters]
        self.single = np.isin(np.arange(256), [b[0] for b in encoded if len(b) == 1])
        self.longer = [b for b in encoded if len(b) > 1]

    def __call__(self, data: np.ndarray) -> np.ndarray:
        out = self.single[data]
        for code in self.longer:
            at = np.flatnonzero(data == code[-1])  # the last byte is the rarest
            at = at[at >= len(code) - 1]
            for k in range(1, len(code)):
                at = at[data[at - k] == code[-1 - k]]
            for k in range(len(code)):
                out[at - k] = True
        return out


class ChunkMemo:
    """Ids of the texts of a slice. ``encode_many`` gives little-endian 32-bit ids, as bytes, for each of some chunks;
    a chunk is known by a 64-bit hash of its bytes."""

    def __init__(self, encode_many: Callable[[list[str]], Iterable[bytes]], spaces: str = SPACES, kept: int = KEPT_CHUNKS) -> None:
        self.encode_many, self.spaces, self.kept, self.hasher = encode_many, Marks(spaces), kept, Hasher()
        self.table: dict[int, bytes] = {}
        self.older: dict[int, bytes] = {}

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, row offsets into them) for UTF-8 bytes and row offsets into those."""
        n = len(data)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        space = self.spaces(data)
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[offsets[offsets < n]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], n)
        distinct, place, inverse = np.unique(self.hasher.spans(data, starts, ends), return_index=True, return_inverse=True)
        ids = self._ids(distinct.tolist(), lambda i: bytes(data[starts[place[i]]:ends[place[i]]]).decode())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, source = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(lengths) - lengths
        each = lengths[inverse]
        upto = np.concatenate(([0], np.cumsum(each)))
        taken = np.arange(upto[-1]) + np.repeat(source[inverse] - upto[:-1], each)
        return pool[taken], upto[np.searchsorted(starts, offsets)]

    def _ids(self, keys: list[int], chunk: Callable[[int], str]) -> list[bytes]:
        if len(self.table) > self.kept:
            self.table, self.older = {}, self.table
        table, older = self.table, self.older
        ids = list(map(table.get, keys))
        new = []
        for i in [i for i, x in enumerate(ids) if x is None]:
            if (x := older.get(keys[i])) is None:
                new.append(i)
            else:
                table[keys[i]] = ids[i] = x
        for i, x in zip(new, self.encode_many([chunk(i) for i in new])):
            table[keys[i]] = ids[i] = x
        return ids


def chunk_encoder(tokenizer, begins: np.ndarray, plain: Callable[[str], bool]) -> Callable[[list[str]], list[bytes]]:
    """Encodes lists of chunks. ``plain`` chunks start with one id that is marked in ``begins`` and have no other such id:
    they are encoded joined, and the marks show where each starts."""

    def encode_many(chunks: list[str]) -> list[bytes]:
        out, rest = [b""] * len(chunks), range(len(chunks))
        joined = [i for i in rest if plain(chunks[i])]
        if joined:
            ids = np.array(tokenizer.encode_batch_fast(["".join(chunks[i] for i in joined)], add_special_tokens=False)[0].ids, "<u4")
            starts = np.flatnonzero(begins[ids])
            if len(starts) == len(joined) and starts[0] == 0:
                data, cuts = ids.tobytes(), np.append(starts * 4, len(ids) * 4).tolist()
                for i, a, b in zip(joined, cuts, cuts[1:]):
                    out[i] = data[a:b]
                done = set(joined)
                rest = [i for i in rest if i not in done]
        for i, e in zip(rest, tokenizer.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    return encode_many


def worker_memo(key: tuple, make: Callable[[], ChunkMemo]) -> ChunkMemo:
    """The memo of this Python worker, made once and used by all its tasks."""
    held = sys.modules.setdefault("_worker_memos", types.ModuleType("_worker_memos")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def released() -> None:
    """Give up this worker's memos and hand freed memory back: a worker that goes on to other work would keep both."""
    held = sys.modules["_worker_memos"].__dict__ if "_worker_memos" in sys.modules else {}
    for key in [k for k in held if isinstance(k, tuple)]:
        del held[key]
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
