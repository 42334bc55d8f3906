"""Exact top-k inner products by a three-phase uniform threshold.

Every vector is cut into ``SLICES`` ranges of dimensions.  A cell of the grid
(query block, candidate block, slice) holds that slice of its vectors alone, so
it knows one part of every score and never a whole one.

1. *Local lists.*  Each cell sends, per query, its k entries with the largest
   parts; a slice's list is the best ``LISTED`` (k at least) over its blocks.  The
   other parts of these listed entries are fetched, and the k-th best whole score
   is a cutoff that no answer can be below.
2. *Sufficient entries.*  The head of a slice's list is the ceiling of that
   slice, and its distance from the mean part the slice's spread.  What the
   ceilings have above the cutoff is the slack.  An entry below every ceiling by
   more than one uniform share (``slack / sum of spreads``) of the slice's spread
   cannot reach the cutoff.  The shares go back to the cells, and each sends the
   entries within its slice's share.
3. *Remaining scores.*  An entry not sent by a slice is below the ceiling there by
   more than its share; those that cannot reach the cutoff any more are left out,
   and the missing parts of the rest are fetched.  Whole scores are ranked.

Equal vectors are one candidate (a class) with the few ids that can be answers,
so copies of one vector never flood the lists with ties.

A block holds at most ``BLOCK_ROWS`` rows and ``BLOCK_NUMBERS`` numbers, and a
cell scores ``QUERIES_AT_ONCE`` queries at a time, whatever the number of rows.

Defined cases: vectors that are NULL, empty or hold NULL, NaN or infinite
components (and rows with a NULL id) take no part; only vectors of the same
width are scored against each other; of repeated ids each row is a candidate
(never for its own id) and queries count once per row; ties go to the smaller
id; fewer than k candidates give fewer rows; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagekit.llm.common import cut
from passagekit.session import ship_package

SLICES = 2
BLOCK_NUMBERS = 1 << 19
BLOCK_ROWS = 1 << 11
QUERIES_AT_ONCE = 64
LISTED = 32  # longer lists make the cutoff higher, so phase 2 sends less; the result is the same
ENTRY = "query_key long, class_key long, slice int, part long, mean double"


def quantised(df: DataFrame, vector_col: str, id_col: str, is_query: Column) -> DataFrame:
    """Rows (vec_id, v, width, asked): floor(256 x) of every component, as long."""
    v = F.col(vector_col)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)
                                                     & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(v, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long")).alias("v"),
        F.size(v).alias("width"), F.coalesce(is_query, F.lit(False)).alias("asked"))


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors (class_key, width, v, ids, low_id, shared).

    ``ids`` has the k + 1 smallest ids of the vector, each at most k times: no
    query can take more, its own id left out.  ``shared``: more than one id.
    """
    counted = rows.withColumn("h", F.xxhash64("v")).groupBy("h", "v", "vec_id").agg(F.count(F.lit(1)).alias("n"))
    least = Window.partitionBy("h", "v").orderBy("vec_id")
    few = counted.withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= k + 1)
    grouped = few.groupBy("h", "v").agg(F.sort_array(F.collect_list(
        F.struct("vec_id", F.least("n", F.lit(k)).cast("int").alias("n")))).alias("held"))
    return grouped.select(
        F.monotonically_increasing_id().alias("class_key"), F.size("v").alias("width"), "v",
        F.flatten(F.transform("held", lambda x: F.array_repeat(x["vec_id"], x["n"]))).alias("ids"),
        F.col("held")[0]["vec_id"].alias("low_id"), (F.size("held") > 1).alias("shared"))


def sliced(df: DataFrame, vector_col: str, width_col: str) -> DataFrame:
    """One row per slice: ``slice`` and that range of the vector in place of the whole."""
    kept = [c for c in df.columns if c != vector_col]
    first = F.floor(F.col(width_col) * F.col("slice") / F.lit(SLICES)).cast("int")
    end = F.floor(F.col(width_col) * (F.col("slice") + 1) / F.lit(SLICES)).cast("int")
    return df.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))).select(
        *kept, "slice", F.slice(vector_col, first + 1, end - first).alias(vector_col))


def blocks(rows: int, width: int) -> int:
    """Blocks so that one holds at most ``BLOCK_NUMBERS`` numbers of a slice and ``BLOCK_ROWS`` rows."""
    most = min(BLOCK_ROWS, BLOCK_NUMBERS * SLICES // max(1, width))
    return max(1, -(-rows // max(1, most)))


def top_of(part: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest parts of a row, ties to the smaller key."""
    if len(part) <= k:
        return np.arange(len(part))
    kth = np.partition(part, len(part) - k)[len(part) - k]
    at = np.flatnonzero(part >= kth)
    return at[np.lexsort((keys[at], -part[at]))[:k]]


def parts_of(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of two blocks of slices."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    # whole numbers below 2^53 are exact as doubles
    return (q.astype(float) @ x.T.astype(float)).astype(np.int64) if bound < 2.0 ** 53 else q @ x.T


def matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.int64) for v in vectors])


def cell(queries, vectors, k: int, listing: bool) -> Iterator[tuple]:
    """Entries of a cell: (query_key, class keys, parts, mean part); the k best, or all down to ``least``."""
    x, keys = matrix(vectors["v"]), vectors["class_key"].to_numpy()
    low, shared = vectors["low_id"].to_numpy(), vectors["shared"].to_numpy(dtype=bool)
    asked, own = queries["query_key"].to_numpy(), queries["query_id"].to_numpy()
    least, bounded = queries["least"].to_numpy(), queries["bounded"].to_numpy(dtype=bool)
    for a in range(0, len(asked), QUERIES_AT_ONCE):
        parts = parts_of(matrix(queries["qv"].iloc[a:a + QUERIES_AT_ONCE]), x)
        for row in range(a, a + len(parts)):
            others = np.flatnonzero(shared | (low != own[row]))
            part = parts[row - a, others]
            if listing:
                at = top_of(part, keys[others], k)
            else:
                at = np.flatnonzero(part >= least[row]) if bounded[row] else np.arange(len(part))
            yield asked[row], keys[others[at]], part[at], float(part.mean()) if len(part) else 0.0


def over_cells(queries: DataFrame, vectors: DataFrame, q_blocks: int, x_blocks: int, k: int,
               listing: bool) -> DataFrame:
    """Rows ``ENTRY`` of all cells (width, query block, candidate block, slice)."""
    import pandas as pd

    ship_package(queries.sparkSession)

    def work(key, q, x):
        found = list(cell(q, x, k, listing)) if len(q) and len(x) else []
        if not found:
            return pd.DataFrame({"query_key": [], "class_key": [], "slice": [], "part": [], "mean": []})
        sizes = [len(f[1]) for f in found]
        return pd.DataFrame({"query_key": np.repeat([f[0] for f in found], sizes),
                             "class_key": np.concatenate([f[1] for f in found]), "slice": int(key[3]),
                             "part": np.concatenate([f[2] for f in found]),
                             "mean": np.repeat([f[3] for f in found], sizes)})

    q = queries.withColumn("qb", F.pmod(F.xxhash64("query_key"), F.lit(q_blocks)).cast("int")).withColumn(
        "xb", F.explode(F.sequence(F.lit(0), F.lit(x_blocks - 1))))
    x = vectors.withColumn("xb", F.pmod(F.xxhash64("class_key"), F.lit(x_blocks)).cast("int")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    return q.groupBy("qw", "qb", "xb", "slice").cogroup(x.groupBy("width", "qb", "xb", "slice")).applyInPandas(
        work, ENTRY)


def fetched(seen: DataFrame, q_parts: DataFrame, x_parts: DataFrame) -> DataFrame:
    """Whole scores (query_key, class_key, score) of entries with ``known`` parts of the slices ``have``."""
    every = F.array(*(F.lit(s) for s in range(SLICES)))
    missing = seen.select("query_key", "class_key", "known", F.explode_outer(F.array_except(every, "have")).alias("slice"))
    products = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, p: s + p)
    parts = missing.join(q_parts.select("query_key", "slice", "qv"), ["query_key", "slice"], "left").join(
        x_parts.select("class_key", "slice", "v"), ["class_key", "slice"], "left").select(
        "query_key", "class_key", "known", F.coalesce(products, F.lit(0).cast("long")).alias("part"))
    return parts.groupBy("query_key", "class_key").agg((F.max("known") + F.sum("part")).alias("score"))


def known_parts(entries: DataFrame) -> DataFrame:
    """Per entry the sum of its known parts and their slices (at most ``SLICES``)."""
    return entries.groupBy("query_key", "class_key").agg(
        F.sum("part").alias("known"), F.collect_list("slice").alias("have"))


def limits_of(listed: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Per query: ``slack`` and the maps slice -> ``ceilings``, ``shares`` (slack and shares NULL: below k candidates).

    Shares add up to the slack at least, whatever the spreads are.
    """
    best = Window.partitionBy("query_key").orderBy(F.desc("score"), "class_key")
    cutoffs = scores.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k).select(
        "query_key", F.col("score").alias("cutoff"))
    heads = listed.groupBy("query_key", "slice").agg(F.max("part").alias("ceiling"), F.avg("mean").alias("mean")).select(
        "query_key", "slice", "ceiling", (F.greatest(F.col("ceiling") - F.col("mean"), F.lit(0.0)) + 1).alias("spread"))
    per_query = heads.groupBy("query_key").agg(
        F.collect_list(F.struct("slice", "ceiling", "spread")).alias("heads"),
        F.sum("ceiling").alias("above"), F.sum("spread").alias("spreads"))
    slack = per_query.join(cutoffs, "query_key", "left").withColumn("slack", F.col("above") - F.col("cutoff"))
    share = (F.floor(F.col("slack") * F.col("spread") / F.col("spreads")) + 1).cast("long")  # 1: for rounding
    return slack.select("query_key", "slack", "spreads", F.explode("heads").alias("x")).select(
        "query_key", "slack", "spreads", "x.*").groupBy("query_key").agg(
        F.max("slack").alias("slack"),
        F.map_from_entries(F.collect_list(F.struct("slice", "ceiling"))).alias("ceilings"),
        F.map_from_entries(F.collect_list(F.struct("slice", share.alias("share")))).alias("shares"))


def sufficient(entries: DataFrame, limits: DataFrame) -> DataFrame:
    """Entries of phase 2 whose known parts still allow the cutoff."""
    seen = known_parts(entries).join(limits, "query_key")
    zero = F.lit(0).cast("long")
    ceiling = F.aggregate("have", zero, lambda s, x: s + F.col("ceilings")[x])
    every = F.array(*(F.lit(s) for s in range(SLICES)))
    unsent = F.aggregate(F.array_except(every, "have"), zero, lambda s, x: s + F.col("shares")[x] + 1)
    return seen.where(F.col("slack").isNull() | (ceiling - F.col("known") + unsent <= F.col("slack") + SLICES)).select(
        "query_key", "class_key", "known", "have")


def top_k(df: DataFrame, is_query: Column, k: int = 5, vector_col: str = "embedding",
          id_col: str = "vec_id") -> DataFrame:
    """Rows (query_id, rank, vec_id, score) of every row where ``is_query`` holds."""
    rows = cut(quantised(df, vector_col, id_col, is_query).withColumn("row_key", F.monotonically_increasing_id()))
    classes = cut(classes_of(rows, k))
    queries = rows.where("asked").select(
        F.col("row_key").alias("query_key"), F.col("vec_id").alias("query_id"), F.col("v").alias("qv"),
        F.col("width").alias("qw"))
    n = classes.agg(F.count(F.lit(1)), F.max("width")).first()
    q_blocks, x_blocks = blocks(queries.count(), n[1] or 1), blocks(n[0], n[1] or 1)
    q_parts = sliced(queries, "qv", "qw")
    x_parts = sliced(classes.drop("ids"), "v", "width")

    unbounded = q_parts.withColumn("least", F.lit(0).cast("long")).withColumn("bounded", F.lit(False))
    local = over_cells(unbounded, x_parts, q_blocks, x_blocks, k, True)
    in_slice = Window.partitionBy("query_key", "slice").orderBy(F.desc("part"), "class_key")
    listed = cut(local.withColumn("nth", F.row_number().over(in_slice)).where(F.col("nth") <= max(k, LISTED)).drop("nth"))
    limits = cut(limits_of(listed, fetched(known_parts(listed), q_parts, x_parts), k))

    bounded = q_parts.join(limits, "query_key").select(
        *q_parts.columns, F.coalesce(F.col("ceilings")[F.col("slice")] - F.col("shares")[F.col("slice")], F.lit(0)).alias(
            "least"), F.col("slack").isNotNull().alias("bounded"))
    sent = over_cells(bounded, x_parts, q_blocks, x_blocks, k, False)
    scores = fetched(cut(sufficient(sent, limits)), q_parts, x_parts)

    # every class has a row that may be taken, so classes after the k-th score hold no answer
    first = scores.withColumn("place", F.rank().over(Window.partitionBy("query_key").orderBy(F.desc("score"))))
    taken = first.where(F.col("place") <= k).join(classes.select("class_key", "ids"), "class_key").select(
        "query_key", "score", F.explode("ids").alias("vec_id")).join(
        queries.select("query_key", "query_id"), "query_key").where("vec_id <> query_id")
    best = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    return taken.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
