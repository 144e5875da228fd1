"""Fingerprints packed in longs, and similarities of fingerprints and vectors, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_signs(vector: Column, size: int) -> Column:
    """array<long> with a bit for each of size values, set if it is positive; bit i of word w is value 64 * w + i + 1."""
    words = []
    for start in range(0, size, 64):
        bits = [F.when(F.get(vector, F.lit(i)) > 0, F.shiftleft(F.lit(1).cast("long"), i - start)).otherwise(F.lit(0).cast("long")) for i in range(start, min(start + 64, size))]
        word = bits[0]
        for b in bits[1:]:
            word = word.bitwiseOR(b)
        words.append(word)
    return F.array(*words)


def bit_total(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.bit_count(w))


def tanimoto(a: Column, b: Column) -> Column:
    """Common bits over all bits; 0 for two fingerprints without bits."""
    both = bit_total(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))
    either = bit_total(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))
    return F.when(either == 0, 0.0).otherwise(both / either)


def set_bits(words: Column) -> Column:
    """Numbers of the bits that are set, ascending."""
    numbers = F.transform(words, lambda w, k: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.getbit(w, i) == 1, k * 64 + i)))
    return F.filter(F.flatten(numbers), lambda x: x.isNotNull())


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a vector of length zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)
