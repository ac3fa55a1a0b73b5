"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line of the text) hashes to a wide vector; the fingerprint is the sum of the vectors, each component
modulo a power of two. It does not depend on the order of paragraphs, and paragraphs can be added or taken out without
the rest of the text (``added``, ``removed``). A vector has two parts:

* ``EXACT`` components of 32 bits from hashes of the whole paragraph: equal sums mean equal multisets of paragraphs;
* ``LANES`` components of 21 bits, three packed in a long, and a count: random bits of the paragraph's sentences. Read as
  signs, they are a random projection of the multiset of sentences, whose inner products give the likeness of two texts.

Everything is a DataFrame expression over one row. Defined cases: null and empty texts have the fingerprint of no
paragraphs, all zeros; two of these are alike (1.0), and one of them and any other text are not (0.0). Lines of white
space are no paragraphs, so texts that differ only in such lines, or in the order of lines, have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = 8
WORDS = 32
LANES = 3 * WORDS
BITS = 21

_LOW = (1 << 32) - 1
_LANE = (1 << BITS) - 1
_MASK = (1 << 3 * BITS) - 1
_BIT = 1 | 1 << BITS | 1 << 2 * BITS


def _hash(seed: int, x: Column) -> Column:
    return F.xxhash64(F.concat(F.lit(f"{seed}:"), x))


def _sum(values: Column, part, mask: int) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: (a + part(v)).bitwiseAND(F.lit(mask)))


def _spread(x: Column, at: int) -> Column:
    """Three bits of ``x`` as the lowest bits of three lanes."""
    moved = [F.shiftrightunsigned(x, at + k) for k in range(3)]
    return moved[0].bitwiseAND(F.lit(1)).bitwiseOR(F.shiftleft(moved[1].bitwiseAND(F.lit(1)), BITS)).bitwiseOR(F.shiftleft(moved[2].bitwiseAND(F.lit(1)), 2 * BITS))


def fingerprint(text: Column) -> Column:
    """array<bigint>: EXACT sums, the number of sentences, WORDS packed sums."""
    paragraphs = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: p.rlike(r"\S"))
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(p, r"(?<=[.!?])\s+")))
    hashes = F.struct(
        F.transform(paragraphs, lambda p: F.array(*[_hash(k, p) for k in range(EXACT // 2)])).alias("p"),
        F.transform(sentences, lambda s: F.struct(_hash(10, s).alias("a"), _hash(11, s).alias("b"))).alias("s"),
    )

    def lanes(x: Column) -> Column:
        exact = [_sum(x["p"], lambda v, k=k, half=half: F.shiftrightunsigned(v[k], 32 * half).bitwiseAND(F.lit(_LOW)), _LOW) for k in range(EXACT // 2) for half in (0, 1)]
        packed = [_sum(x["s"], lambda v, j=j: _spread(v["a"], 3 * j) if j < 21 else _spread(v["b"], 3 * (j - 21)), _MASK) for j in range(WORDS)]
        return F.array(*exact, F.size(x["s"]).cast("bigint"), *packed)

    return F.transform(F.array(hashes), lanes)[0]


def _masks() -> Column:
    return F.array(*[F.lit(_LOW)] * EXACT, *[F.lit(_MASK)] * (1 + WORDS))


def added(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of both."""

    def total(x: Column, y: Column) -> Column:
        # the highest bit is added without its carry, as a sum of two numbers of 63 bits need not fit a long
        low = x.bitwiseAND(F.lit(_MASK >> 1)) + y.bitwiseAND(F.lit(_MASK >> 1))
        return low.bitwiseXOR(x.bitwiseXOR(y).bitwiseAND(F.lit(_MASK ^ _MASK >> 1)))

    return F.zip_with(F.zip_with(a, b, total), _masks(), lambda x, m: x.bitwiseAND(m))


def removed(a: Column, b: Column) -> Column:
    """The fingerprint of ``a`` without the paragraphs of ``b``, all of which must be in it."""
    return F.zip_with(F.zip_with(a, b, lambda x, y: x - y), _masks(), lambda x, m: x.bitwiseAND(m))


def as_text(a: Column) -> Column:
    """Lower-case hex digits, 16 for each component."""
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Shared sentences against all sentences of two texts, from their fingerprints alone; 0 to 1, 1 for equal ones."""

    def product(x: Column, y: Column) -> Column:
        def signed(v: Column, n: Column, k: int) -> Column:
            return (2 * F.shiftrightunsigned(v, BITS * k).bitwiseAND(F.lit(_LANE)) - n).cast("double")

        terms = F.zip_with(F.slice(x, EXACT + 2, WORDS), F.slice(y, EXACT + 2, WORDS), lambda v, w: sum((signed(v, x[EXACT], k) * signed(w, y[EXACT], k) for k in range(3)), F.lit(0.0)))
        return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)

    whole = product(a, a) + product(b, b)
    shared = F.when(whole > 0, 2 * product(a, b) / whole).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), shared)))
