"""Byte-pair encoding with word ends by speculation: propose tokens, verify them, merge only what fails.

A word is cut greedily into the longest tokens of the vocabulary; all words of a batch walk one trie together. Each pair
of neighbouring tokens is then tested: undoing the merges that made the two tokens, latest first, no merge across their
border may have come before the merge that used one of its sides up. A word whose pairs all pass has the very tokens that
merging would give; any other word is merged exactly. Texts reach this code as distinct chunks (white space and the run
after it) of which a worker keeps the ids, as no token joins text across white space.

The tokenizer file's own normaliser and word splitter are used, through the tokenizers library; truncation and padding of
the file are not used, and strings of its added tokens in a text become those tokens.

Defined cases: a null text is the empty text and has no ids. Null ids decode to null, ids outside the vocabulary to
nothing. Repeated rows and rows of a null id are encoded as any other. Columns other than the named ones are not returned.
A chunk is known by a 64-bit hash of its bytes.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe_memo import ChunkMemo, worker_memo
from .common import text_slices

#: Bytes of text that are encoded in one call.
CALL_BYTES = 1 << 20
#: Symbols of words that are proposed and verified together; one longer word is a batch of its own.
BATCH_SYMBOLS = 1 << 18
#: The symbol after the last byte of a word.
END = 256
_NEVER = np.int64(1) << 40
NO_MERGE = (1 << 40, -1)
#: Words of up to so many bytes are merged by scanning their pairs, longer ones with a queue.
SHORT_WORD = 48
#: Rows that are decoded between two batches.
SLICE_ROWS = 256
#: So many words are kept by a worker in each of two generations.
KEPT_WORDS = 300_000


def byte_symbols() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves, others follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges and trie of a byte-pair model as arrays. ``vocab`` and ``merges`` are those of the tokenizer file."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str) -> None:
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        size = max(vocab.values()) + 1
        self.size, symbols = size, byte_symbols()
        left, right, made = (np.fromiter(x, np.int64, len(pairs)) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs))) if pairs else (np.zeros(0, np.int64),) * 3
        self.rank = np.full(size, -1, np.int64)  # which merge makes a token; -1: none does
        self.rank[made] = np.arange(len(pairs))
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.left[made], self.right[made] = left, right
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order
        self.merges = {k: (r, t) for r, (k, t) in enumerate(zip(keys.tolist(), made.tolist()))}
        if len(np.unique(made)) < len(made) or (len(made) and (np.maximum(self.rank[left], self.rank[right]) >= np.arange(len(made))).any()):
            raise ValueError("every merge must make a token of its own from tokens made before")
        sound = self._sound()
        self.base = {}
        steps: dict[tuple[int, int], int] = {}
        token = [-1]
        for text, i in vocab.items():
            ends = bool(suffix) and text.endswith(suffix)
            body = text[:-len(suffix)] if ends else text
            if not all(c in symbols for c in body):
                continue
            spelled = [symbols[c] for c in body] + [END] * ends
            if len(body) == 1:
                self.base[spelled[0], ends] = i
            if self.rank[i] >= 0 and not sound[i] or self.rank[i] < 0 and len(body) != 1:
                continue  # no text merges to it
            state = 0
            for s in spelled:
                if (state, s) not in steps:
                    steps[state, s] = len(token)
                    token.append(-1)
                state = steps[state, s]
            token[state] = i
        if missing := [(b, e) for b in range(256) for e in (False, True) if (b, e) not in self.base]:
            raise ValueError(f"no token for {len(missing)} single bytes")
        keys = np.fromiter((s * 257 + c for s, c in steps), np.int64, len(steps))
        order = np.argsort(keys)
        self.step_keys, self.step_states = keys[order], np.fromiter(steps.values(), np.int64, len(steps))[order]
        self.token = np.array(token, np.int64)
        self.first = np.full(257, -1, np.int64)
        self.first[self.step_keys[self.step_keys < 257]] = self.step_states[self.step_keys < 257]

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of a and b; _NEVER where there is none."""
        keys = a * self.size + b
        if not len(self.pair_keys):
            return np.full(len(keys), _NEVER)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether tokens a and b, side by side, stay apart when their bytes are merged by all merges (of ranks under ``until``)."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), _NEVER - 1) if until is None else until.astype(np.int64)
        out, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y, cut = a[live], b[live], limit[live]
            meets = self._pair_rank(x, y) < cut
            out[live[meets]] = False
            rx, ry = self.rank[x], self.rank[y]
            undo_left = rx > ry  # of one rank the left token was made first
            # before the latest of the two merges: its inner part touches the border and is used up by that merge. Of the
            # same merge on both sides of a token, the left one comes first: a tie is a merge across the border on the right side only
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            limit[live] = np.where(undo_left, rx, ry + 1)
            live = live[~meets & (np.maximum(rx, ry) >= 0)]
        return out

    def _sound(self) -> np.ndarray:
        """Which tokens their own bytes merge to: the two parts are, and stay apart until the merge that joins them."""
        made = np.flatnonzero(self.rank >= 0)
        alone = np.ones(self.size, bool)
        alone[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        sound, left, right = alone.tolist(), self.left.tolist(), self.right.tolist()
        for t in made[np.argsort(self.rank[made])].tolist():
            sound[t] = sound[t] and sound[left[t]] and sound[right[t]]
        return np.array(sound)

    def propose(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token, length) of the longest match at every position of words that END closes; a match leaves no END alone."""
        n = len(symbols)
        token, length = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        at = np.flatnonzero(symbols != END)
        state, depth = self.first[symbols[at]], 1
        while len(at):
            known = state >= 0
            at, state = at[known], state[known]
            found = self.token[state]
            after = symbols[np.minimum(at + depth, n - 1)]
            fits = (found >= 0) & ((after != END) | (symbols[at + depth - 1] == END))
            token[at[fits]], length[at[fits]] = found[fits], depth
            go = symbols[at + depth - 1] != END
            at, keys = at[go], state[go] * 257 + after[go]
            where = np.minimum(np.searchsorted(self.step_keys, keys), len(self.step_keys) - 1)
            state = np.where(self.step_keys[where] == keys, self.step_states[where], -1)
            depth += 1
        return token, length

    def exact(self, word: bytes) -> list[int]:
        """Ids of a word by its merges, in the order of rank and place."""
        base, last = self.base, len(word) - 1
        ids = [base[b, False] for b in word[:-1]] + [base[word[last], True]]
        return self._scanned(ids) if last < SHORT_WORD else self._queued(ids)

    def _scanned(self, ids: list[int]) -> list[int]:
        size, merge = self.size, self.merges.get
        found = [merge(a * size + b, NO_MERGE) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) is not NO_MERGE:
            i = found.index(best)
            ids[i:i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = merge(ids[i - 1] * size + ids[i], NO_MERGE)
            if i < len(found):
                found[i] = merge(ids[i] * size + ids[i + 1], NO_MERGE)
        return ids

    def _queued(self, ids: list[int]) -> list[int]:
        n, size, merges = len(ids), self.size, self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*m, i) for i in range(n - 1) if (m := merges.get(ids[i] * size + ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            rank, made, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or merges.get(ids[i] * size + ids[j], (-1,))[0] != rank:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := merges.get(made * size + ids[after[i]]):
                    heapq.heappush(heap, (*m, i))
            if before[i] >= 0 and (m := merges.get(ids[before[i]] * size + made)):
                heapq.heappush(heap, (*m, before[i]))
        return [x for x in ids if x >= 0]

    def words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of every word (none is empty)."""
        out: list[list[int]] = []
        lo, held = 0, 0
        for hi, w in enumerate(words):
            if held and held + len(w) >= BATCH_SYMBOLS:
                out += self._batch(words[lo:hi])
                lo, held = hi, 0
            held += len(w) + 1
        return out + self._batch(words[lo:]) if words[lo:] else out

    def _batch(self, words: list[bytes]) -> list[list[int]]:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths)
        symbols = np.full(ends[-1], END, np.int64)
        body = np.ones(len(symbols), bool)
        body[ends - 1] = False
        symbols[body] = np.frombuffer(b"".join(words), np.uint8)
        token, length = self.propose(symbols)
        onward, start = (np.arange(len(symbols)) + length).tolist(), (ends - lengths).tolist()
        places, counts = [], []
        for p, end in zip(start, ends.tolist()):
            k = len(places)
            while p < end:
                places.append(p)
                p = onward[p]
            counts.append(len(places) - k)
        tokens = token[places]
        owner = np.repeat(np.arange(len(words)), counts)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(tokens[inner] * self.size + tokens[inner + 1], return_inverse=True)
        passed = self.compatible(pairs // self.size, pairs % self.size)[back]
        failed = np.zeros(len(words), bool)
        failed[owner[inner[~passed]]] = True
        ids, cuts = tokens.tolist(), np.concatenate(([0], np.cumsum(counts))).tolist()
        return [self.exact(w) if bad else ids[a:b] for w, bad, a, b in zip(words, failed.tolist(), cuts, cuts[1:])]


def load(path: str):
    """(vocabulary, function of a text to its normalised words and added tokens) of a tokenizer file."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, added = spec["model"], spec["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("added tokens must be plain strings of the text itself")
    vocabulary = Vocabulary(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
    tokenizer = Tokenizer.from_file(path)
    normalised, split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
    marks = {t["content"]: t["id"] for t in added}
    finder = re.compile("(" + "|".join(map(re.escape, sorted(marks, key=len, reverse=True))) + ")") if marks else None
    back = {ord(c): b for c, b in byte_symbols().items()}

    def words(text: str) -> list[bytes | int]:
        out: list[bytes | int] = []
        for part in finder.split(text) if finder else [text]:
            if part in marks:
                out.append(marks[part])
            elif part:
                out += [w.translate(back).encode("latin-1") for w, _ in split(normalised(part))]
        return out

    return vocabulary, words


def encoder(path: str) -> ChunkMemo:
    vocabulary, words_of = load(path)
    kept: list[dict[bytes | int, bytes]] = [{}, {}]

    def encode_many(chunks: list[str]) -> Iterator[bytes]:
        cut = [words_of(c) for c in chunks]
        if len(kept[0]) > KEPT_WORDS:
            kept[:] = [{}, kept[0]]
        known, older, new = *kept, []
        for w in {w for ws in cut for w in ws if w not in known}:
            if isinstance(w, int):
                known[w] = np.uint32(w).tobytes()
            elif w in older:
                known[w] = older[w]
            else:
                new.append(w)
        known.update((w, np.array(ids, "<u4").tobytes()) for w, ids in zip(new, vocabulary.words(new)))
        return (b"".join([known[w] for w in ws]) for ws in cut)

    return ChunkMemo(encode_many)


def encoded(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids of every whole text. ``tokenizer`` is a file that every executor can open."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = worker_memo(("speculative", tokenizer), lambda: encoder(tokenizer))
        for batch in batches:
            for lo, hi, data, rows_at in text_slices(batch.column("text"), CALL_BYTES):
                ids, cuts = memo.encode(data, rows_at)
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(cuts)), lists], names=["doc_id", "n_tokens", "ids"])

    return rows.mapInArrow(encode, T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("n_tokens bigint, ids array<int>").fields]))


def token_texts(path: str) -> list[str | None]:
    """The text of every id as the file writes it, word ends included."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    known = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [known.get(i) for i in range(max(known, default=-1) + 1)]


def decoded(rows: DataFrame, tokenizer: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """``rows`` with the text of their ids in column ``into``: the tokens joined by a space, added tokens included, as a file without
    a decoder asks for."""
    with open(tokenizer, encoding="utf-8") as f:
        if json.load(f).get("decoder"):
            raise ValueError("only files without a decoder are decoded here")
    place, names = rows.columns.index(ids), [*rows.columns, into]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_memo(("token texts", tokenizer), lambda: token_texts(tokenizer))

        def joined(x: np.ndarray) -> str:
            inside = x[(x >= 0) & (x < len(known))] if len(x) and (x.min() < 0 or x.max() >= len(known)) else x
            return " ".join(t for t in map(known.__getitem__, inside.tolist()) if t is not None)

        for batch in batches:
            lists = batch.column(place)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for lo in range(0, len(batch), SLICE_ROWS):
                hi = min(len(batch), lo + SLICE_ROWS)
                valid = lists.slice(lo, hi - lo).is_valid().to_pylist()
                texts = [joined(values[offsets[i]:offsets[i + 1]]) if ok else None for i, ok in zip(range(lo, hi), valid)]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), pa.array(texts, pa.string())], names=names)

    return rows.mapInArrow(decode, T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())]))
