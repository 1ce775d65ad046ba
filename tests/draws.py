"""Repeatable pseudo-random draws from a row's own key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_PER_HASH = 8  # 64 hex digits of SHA-256, eight per draw


class Draws:
    """Independent 32-bit draws for a key: the same whatever the partitioning or cluster."""

    def __init__(self, key: Column, seed: int):
        self._key = key
        self._seed = seed

    def integer(self, number: int) -> Column:
        """Draw `number` (0, 1, 2, ...) as a bigint in [0, 2^32)."""
        text = F.concat(F.lit(f"{self._seed}:{number // _PER_HASH}:"), self._key.cast("string"))
        digits = F.substring(F.sha2(text, 256), 1 + 8 * (number % _PER_HASH), 8)
        return F.conv(digits, 16, 10).cast("bigint")

    def between(self, number: int, low: int, high: int) -> Column:
        """Uniform whole number from low to high, both included."""
        return F.lit(low) + F.pmod(self.integer(number), F.lit(high - low + 1))

    def choice(self, number: int, values: Sequence[str]) -> Column:
        return pick(values, F.pmod(self.integer(number), F.lit(len(values))))


def pick(values: Sequence[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))
