"""Hash-seeded randomness.

Every draw is a function of a row key and a salt, so a value does not change with the number of
partitions, with task retries or between runs (``rand`` and ``randn`` change with all three).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def keyed_md5(key: Column, salt: str = "") -> Column:
    text = key.cast("string")
    return F.md5(F.concat(text, F.lit("|" + salt)) if salt else text)


def hex_word(digest: Column, position: int) -> Column:
    """Eight hex digits of a digest as an unsigned 32-bit number."""
    return F.conv(F.substring(digest, position, 8), 16, 10).cast("bigint")


def hash32(key: Column, salt: str = "") -> Column:
    return hex_word(keyed_md5(key, salt), 1)


def fold(key: Column, k: int, salt: str = "") -> Column:
    """Deterministic fold number 0..k-1."""
    return (hash32(key, salt) % k).cast("int")


def normal(key: Column, salt: str) -> Column:
    """Standard normal draw: Box-Muller on two 32-bit words of the digest."""
    digest = keyed_md5(key, salt)
    u1 = (hex_word(digest, 1) + 0.5) / TWO_32
    u2 = (hex_word(digest, 9) + 0.5) / TWO_32
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)
