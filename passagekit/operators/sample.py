"""Reproducible sampling and batch splitting.

``RAND()`` of the reference is replaced by ``unit_hash(key, seed)``: the
decision for a row depends on its key only, so reruns, retried tasks and
different partition counts draw the same rows, and a smaller rate draws a
subset of a larger one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagekit.functions.hashing import unit_hash
from passagekit.session import checkpoint_dir

_LOCAL_BITS = 33


def sample_rate(df: DataFrame, p: float, key: str, seed: int = 0) -> DataFrame:
    """Bernoulli sample: keep rows whose key hash is below ``p`` (a filter in the scan stage)."""
    return df.where(unit_hash(key, seed=seed) < F.lit(float(p)))


def sample_about(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """About ``n`` rows: rate n / count(*), the count being a scalar subquery of the plan."""
    total = df.select(F.count(F.lit(1))).scalar()
    return df.where(unit_hash(key, seed=seed) < F.lit(float(n)) / total)


def sample_per_group(df: DataFrame, group: str, n: int, key: str, seed: int = 0) -> DataFrame:
    """Up to ``n`` random rows per group (``row_number() over (partition by group
    order by RAND()) <= n``).  Catalyst plans a partial WindowGroupLimit before
    the shuffle, so a hot group ships at most n rows per map task."""
    w = Window.partitionBy(group).orderBy(unit_hash(key, seed=seed), F.col(key))
    return df.withColumn("_pos", F.row_number().over(w)).where(F.col("_pos") <= n).drop("_pos")


def row_index(df: DataFrame, order: list, out: str = "row_idx", partitions: int | None = None) -> DataFrame:
    """0-based position in a global order, without a single-task window.

    Range shuffle on the order, sort inside partitions, stamp each row with
    (partition, local position), and add the row count of all earlier
    partitions (one row per partition, broadcast).  The stamped rows are
    checkpointed before they are counted and joined: both consumers then
    read the very same partitioning, even if range bounds (sampled) or a lost
    executor would make a recomputation partition differently.  The order
    must be total (unique) for a deterministic result.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n_part = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # monotonically_increasing_id = partition index << 33 | position in partition
    ranged = (df.repartitionByRange(n_part, *order).sortWithinPartitions(*order)
              .withColumn("_mid", F.monotonically_increasing_id())
              .withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
              .withColumn("_loc", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
              .drop("_mid")
              .checkpoint())
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_off") + F.col("_loc"))
            .drop("_pid", "_loc", "_off"))


def assign_batches(df: DataFrame, num_batches: int, order: list, out: str = "batch_id") -> DataFrame:
    """Split into ``num_batches`` nearly equal batches, 1-based ids.

    Same sizes as ``numpy.array_split`` / SQL ``ntile``: the first
    ``rows % num_batches`` batches hold one extra row.
    """
    idx = row_index(df, order, "_i")
    # the stamped rows are stored, so the total is read off them, not off the source
    total = idx.select(F.count(F.lit(1))).scalar()
    q, r = F.floor(total / F.lit(num_batches)), total % F.lit(num_batches)
    big = r * (q + 1)
    i = F.col("_i")
    batch = F.when(i < big, F.floor(i / (q + 1))).otherwise(r + F.floor((i - big) / F.greatest(q, F.lit(1)))) + 1
    return idx.withColumn(out, batch.cast("int")).drop("_i")


def first_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of a total order, over many tasks (no single-task top-n):
    place in the order, then a filter."""
    return row_index(df, order, "_i").where(F.col("_i") < n).drop("_i")


def build_batches(df: DataFrame, batch_size: int, num_batches: int, key: str, seed: int = 0) -> DataFrame:
    """Sample about batch_size * num_batches rows and split them into batches.

    The rows get ``questions = ''`` like the reference; order inside the
    sample is by (hash, key), i.e. random but reproducible.
    """
    s = sample_about(df, batch_size * num_batches, key, seed)
    s = s.withColumn("_u", unit_hash(key, seed=seed))
    out = assign_batches(s, num_batches, [F.col("_u"), F.col(key)])
    return out.drop("_u").withColumn("questions", F.lit(""))
