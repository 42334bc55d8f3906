"""Reproducible pseudo-randomness as column expressions.

``unit_hash(key, seed)`` maps a key to [0, 1) from the first 32 bits of
``md5(seed || '|' || key)``.  It depends only on the row's key, never on
partitioning or task order, so re-running a job (or a lost task) draws the
same sample, and any SQL engine with md5 computes the same value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _key(*cols) -> Column:
    parts = [c if isinstance(c, Column) else F.col(c) for c in cols]
    return F.concat_ws("|", *[p.cast("string") for p in parts])


def _first_bits(*cols, seed: int | str) -> Column:
    """The first 32 bits of the hash, as eight hexadecimal digits."""
    return F.substring(F.md5(F.concat(F.lit(str(seed)), F.lit("|"), _key(*cols))), 1, 8)


def hash_order(*cols, seed: int | str = 0) -> Column:
    """A text that sorts as ``unit_hash`` of the same columns does, without making a number of it."""
    return _first_bits(*cols, seed=seed)


def unit_hash(*cols, seed: int | str = 0) -> Column:
    """Uniform value in [0, 1) determined by ``seed`` and the key columns."""
    return F.conv(_first_bits(*cols, seed=seed), 16, 10).cast("double") / F.lit(TWO_32)
