"""Repeatable chance: hashes of seed and key, the same under any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(seed: int | str, *key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in key)))


def uniform(seed: int | str, *key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the hash."""
    return F.conv(F.substring(hash_order(seed, *key), 1, 8), 16, 10).cast("double") / 4294967296.0


def normal(seed: int | str, *key: Column) -> Column:
    """Box-Muller over two uniforms."""
    return F.sqrt(-2 * F.log(1 - uniform(f"{seed}a", *key))) * F.cos(2 * math.pi * uniform(f"{seed}b", *key))
