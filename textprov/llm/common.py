"""What the operators of this package share: intermediate tables and words of Arrow texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir

#: Texts are worked on in slices of about so many bytes; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BYTES = np.arange(256, dtype=np.uint8)
_IS_WORD = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
_LOWERED = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint64) + np.uint64(1)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: the plan behind it is cut, and lost executors cost no more than reads."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to be none of the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string()).fill_null("")
    n, buffers = len(texts), texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, np.int64)
    return offsets, np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)


def text_lengths(texts: pa.Array) -> np.ndarray:
    """Bytes of every text; 0 for null."""
    return np.diff(_buffers(texts)[0])


def _ranges(offsets: np.ndarray, target: int) -> Iterator[tuple[int, int]]:
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + target, "right")) - 1)
        yield lo, hi
        lo = hi


def text_slices(texts: pa.Array, target: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, row offsets into them); null counts as the empty text."""
    offsets, data = _buffers(texts)
    for lo, hi in _ranges(offsets, target):
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]


def text_lists(texts: pa.Array, target: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, end row, texts) of slices; null counts as the empty text."""
    for lo, hi in _ranges(_buffers(texts)[0], target):
        yield lo, hi, [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]


class Hasher:
    """64-bit hashes of all words of a slice; keeps the power tables between slices."""

    def __init__(self) -> None:
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _tables(self, n: int) -> None:
        if n > len(self.powers):
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            for name, base in (("powers", _BASE), ("inverse", inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words (runs of digits, ASCII letters in lower case, and bytes from 0x80) and row offsets into them."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        inside = _IS_WORD[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[offsets < n]
        first[cuts] = inside[cuts]
        cuts = offsets[offsets > 0] - 1
        last[cuts] = inside[cuts]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return self._spans(_LOWERED[data], starts, ends), np.searchsorted(starts, offsets)

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of spans of bytes, taken as they are."""
        return self._spans(data.astype(np.uint64) + np.uint64(1), starts, ends)

    def _spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(values)
        self._tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.powers[:n], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
