"""Repeatable pseudo-random draws: a pure function of row key and salt.

A draw never depends on partitioning, so a lost task recomputes the same rows.
"""

from pyspark.sql import functions as F

BITS = 60
_RANGE = 1 << BITS


def draw(salt, *keys):
    """Integer in [0, 2**60) from the first fifteen hex digits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(salt), *[F.col(k).cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("bigint")


def whole(salt, low, high, *keys):
    """Integer in [low, high]; bounds are numbers or columns."""
    low, high = _column(low), _column(high)
    return low + draw(salt, *keys) % (high - low + 1)


def uniform(salt, low, high, *keys):
    """Real number in [low, high)."""
    low, high = _column(low), _column(high)
    return low + (high - low) * (draw(salt, *keys) / F.lit(float(_RANGE)))


def _column(value):
    return F.col(value) if isinstance(value, str) else F.lit(value)
