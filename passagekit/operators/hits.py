"""Top-k hits that are kept and extended instead of searched again.

The k nearest of an index that grew are among the k nearest of its old part and
the k nearest of what was added, so a stored hit table is merged with the hits
among the added vectors only.  Merging is a window per query over at most k rows
of each part (planned with a partial group limit); ids order equal distances, so
the parts must use the ids of the whole index.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagekit.operators.vectors import knn


def merge_hits(parts: list[DataFrame], k: int, q_key: str = "query_id", x_key: str = "vec_id",
               group: str | None = None) -> DataFrame:
    """The k nearest of all parts per query (and group); an id that two parts hold counts once.

    Parts have the columns of ``vectors.knn`` (further columns are carried along).
    """
    of = [group, q_key] if group else [q_key]
    whole = reduce(DataFrame.unionByName, parts).drop("rank").dropDuplicates([*of, x_key])
    w = Window.partitionBy(*of).orderBy("d2", x_key)
    ranked = whole.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(*parts[0].columns)


def search_appended(stored: DataFrame, queries: DataFrame, appended: DataFrame, k: int, **options) -> DataFrame:
    """Hits of the extended index: the stored hits and a search of the appended rows only."""
    names = {n: options[n] for n in ("q_key", "x_key", "group") if n in options}
    return merge_hits([stored, knn(queries, appended, k, **options)], k, **names)
