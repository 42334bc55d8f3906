"""Exploding computed arrays without duplicating their computation.

For a plain ``explode(expr)`` Catalyst infers ``size(expr) > 0`` and pushes
that filter below the projections, down to the scan -- which evaluates an
expensive ``expr`` (a regex chain over a whole text, a per-row aggregate)
a second time.  The outer generators get no inferred filter; rows of empty
arrays come back as one NULL row and are dropped right after the generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keep: list, arr: Column, names: list[str]) -> DataFrame:
    """``select(*keep, explode(arr) as names)`` -- one name, or two with a position
    (``posexplode``).  Same rows as the inner generator for arrays without
    NULL elements; NULL elements are dropped."""
    if len(names) == 2:
        out = df.select(*keep, F.posexplode_outer(arr).alias(*names))
    else:
        out = df.select(*keep, F.explode_outer(arr).alias(names[0]))
    return out.where(F.col(names[0]).isNotNull())
