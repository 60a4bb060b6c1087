"""Vector expressions on array columns; everything stays in the JVM.

Arithmetic is in double whatever the storage type. A null vector gives null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12
DIGITS = 6  # scores are rounded before ranking, so that ties are ties on any engine


def _col(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though used for every element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(v: Column | str) -> Column:
    return F.transform(_col(v), lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column | str, eps: float = EPS) -> Column:
    """Unit length; a zero vector stays zero."""
    named = let(doubles(v), lambda d: F.struct(d.alias("v"), F.greatest(norm(d), F.lit(eps)).alias("n")))
    return let(named, lambda s: F.transform(s["v"], lambda x: x / s["n"]))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Of vectors that needn't have unit length."""
    return dot(l2_normalize(a), l2_normalize(b))


def l2_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - d^2 / 2, the cosine if both have unit length."""
    d2 = F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return 1 - d2 / 2


def concat_renorm(vectors: list[Column | str], weights: list[float] | None = None) -> Column:
    """Weighted concatenation of unit vectors, brought to unit length."""
    weights = weights or [1.0] * len(vectors)
    if len(weights) != len(vectors) or not vectors:
        raise ValueError("one weight for each vector, and one vector at least")

    def scaled(v: Column | str, w: float) -> Column:
        return F.transform(l2_normalize(v), lambda x: x * w)

    return l2_normalize(F.concat(*[scaled(v, w) for v, w in zip(vectors, weights)]))


def rounded(v: Column | str, digits: int = DIGITS) -> Column:
    """Each component rounded; one that becomes zero keeps its sign, as IEEE and SQL engines have it
    (Spark's ``round`` goes through decimals, which have no negative zero)."""
    return F.transform(doubles(v), lambda x: F.when(F.abs(x) < 0.5 / 10**digits, x * 0.0).otherwise(F.round(x, digits)))


def min_max(v: Column | str) -> Column:
    """Each component moved to [0, 1] over the vector; a constant vector becomes zeros."""
    named = let(doubles(v), lambda d: F.struct(d.alias("v"), F.array_min(d).alias("low"), F.array_max(d).alias("high")))
    return let(named, lambda s: F.transform(s["v"], lambda x: F.when(s["high"] > s["low"], (x - s["low"]) / (s["high"] - s["low"])).otherwise(0.0)))


def sign_bits(v: Column | str) -> Column:
    """One bit a component, set where it is not negative."""
    return F.transform(_col(v), lambda x: (x >= 0).cast("int"))


def pack_bits(bits: Column | str, word: int = 64) -> Column:
    """Bits as an array of integers of ``word`` bits, the first bit highest, padded with zeros."""
    bits = _col(bits)
    words = F.ceil(F.size(bits) / F.lit(word)).cast("int")

    def pack(k: Column) -> Column:
        part = F.slice(bits, k * word + 1, F.lit(word))
        value = F.aggregate(part, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b.cast("long")))
        return F.call_function("shiftleft", value, F.lit(word) - F.size(part))

    return F.when(F.size(bits) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), words - 1), pack))


def unpack_bits(words: Column | str, n_bits: int, word: int = 64) -> Column:
    places = F.sequence(F.lit(0), F.lit(n_bits - 1))
    words = _col(words)
    return F.transform(places, lambda i: F.call_function("shiftright", F.element_at(words, F.floor(i / word).cast("int") + 1), F.lit(word - 1) - i % word).bitwiseAND(F.lit(1)).cast("int"))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two packed codes."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def log2(x: Column) -> Column:
    return F.log(x) / F.lit(math.log(2))
