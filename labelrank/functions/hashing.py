"""Reproducible pseudo-randomness from row keys.

A hash of (seed, key) does not depend on partitioning or task order, so a retried task gives the same
rows. md5 is used because every SQL engine has it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_BITS = 32
_WORDS_PER_DIGEST = 4


def _digest(*parts: Column | str | int) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def _word(digest: Column, n: int) -> Column:
    """The n-th 32-bit word of a hex digest, as an unsigned number."""
    return F.conv(F.substring(digest, 1 + 8 * n, 8), 16, 10).cast("bigint")


def key_hash(seed: int, *keys: str | Column) -> Column:
    """32-bit unsigned hash of the key columns."""
    return _word(_digest(seed, *[F.col(k) if isinstance(k, str) else k for k in keys]), 0)


def key_uniform(seed: int, *keys: str | Column) -> Column:
    """Uniform number in [0, 1) from the key columns."""
    return key_hash(seed, *keys) / F.lit(float(2**HASH_BITS))


def hash_uniforms(seed: int, key: str, n: int) -> list[Column]:
    """n independent uniforms per row; one digest serves four of them."""
    return [
        _word(_digest(seed, i // _WORDS_PER_DIGEST, F.col(key)), i % _WORDS_PER_DIGEST)
        / F.lit(float(2**HASH_BITS))
        for i in range(n)
    ]
