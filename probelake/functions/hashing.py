"""Keyed randomness: every draw is a pure function of (seed, stream, key), never of partitioning.

Draws come from md5 text, which any SQL engine reproduces: hex digits 1-13 and 14-26 of
``md5(seed|stream|key...)`` are two independent 52-bit uniforms.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from probelake.functions.scalars import col

_SCALE = float(1 << 52)


def key_text(seed: int, *parts) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), *[col(p).cast("string") for p in parts])


def shuffle_key(seed: int, *parts) -> Column:
    """Text whose sort order is a seeded shuffle of the keys."""
    return F.md5(key_text(seed, *parts))


def _fraction(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 13), 16, 10).cast("bigint") / _SCALE


def uniform(seed: int, stream: str, *parts) -> Column:
    """U[0, 1) for (seed, stream, key)."""
    return _fraction(F.md5(key_text(seed, F.lit(stream), *parts)), 1)


def digest(seed: int, stream: str, *parts) -> Column:
    """The md5 text behind one draw."""
    return F.md5(key_text(seed, F.lit(stream), *parts))


def gaussian(seed: int, stream: str, *parts) -> Column:
    """N(0, 1) for (seed, stream, key)."""
    return gaussian_of(digest(seed, stream, *parts))


def gaussian_of(digest: Column) -> Column:
    """Box-Muller from the two uniforms of one digest."""
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - _fraction(digest, 1))) * F.cos(F.lit(2.0) * F.pi() * _fraction(digest, 14))


def below(n, seed: int, stream: str, *parts) -> Column:
    """Uniform integer in [0, n)."""
    return F.floor(uniform(seed, stream, *parts) * col(n).cast("double")).cast("bigint")


# the same draws as SQL text, for engines that check the results
def uniform_sql(seed: int, stream: str, *parts: str) -> str:
    key = " || '|' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x' || substr(md5('{seed}|{stream}|' || {key}), 1, 13))::BIGINT / {_SCALE}::DOUBLE)"


def gaussian_sql(seed: int, stream: str, *parts: str) -> str:
    key = " || '|' || ".join(f"({p})::VARCHAR" for p in parts)
    digest = f"md5('{seed}|{stream}|' || {key})"
    part = lambda at: f"(('0x' || substr({digest}, {at}, 13))::BIGINT / {_SCALE}::DOUBLE)"
    return f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {part(1)})) * cos(2.0::DOUBLE * pi() * {part(14)}))"
