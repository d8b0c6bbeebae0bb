"""Bloom filters as literals of expressions, on built-in functions."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Bloom(NamedTuple):
    """Holds every key that it was made from, and some others."""

    seed: int
    bits: int
    hashes: int
    words: str  # the filter's 64-bit words, comma-separated

    def has(self, key: Column) -> Column:
        words = F.split(F.lit(self.words), ",").cast("array<bigint>")  # folded to one literal
        out = None
        for at in _places(key, self.seed, self.bits, self.hashes):
            one = F.call_function("shiftright", F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
            out = one if out is None else out & one
        return out

    @classmethod
    def of(cls, keys: DataFrame, n: int, error: float, seed: int, most: int | None = None) -> Bloom:
        """The filter of the ``n`` keys in column ``key``; with ``most`` bits at most, which makes more errors and misses no key."""
        bits = max(64, 64 * math.ceil(1.45 * math.log2(1 / error) * n / 64))
        bits = min(bits, most) if most else bits
        hashes = max(1, round(bits / max(n, 1) * math.log(2)))
        hashes = min(hashes, max(1, math.ceil(math.log2(1 / error))))
        at = keys.select(F.explode(F.array(*_places(F.col("key"), seed, bits, hashes))).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))).alias("bits"))
        held = [0] * (bits // 64)
        for row in words.collect():  # as many rows as a filter has words
            held[row["word"]] = row["bits"]
        return cls(seed, bits, hashes, ",".join(map(str, held)))


def _places(key: Column, seed: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed), F.lit(j)), F.lit(bits)) for j in range(hashes)]
