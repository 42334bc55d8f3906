"""Batch processing of a work queue (the reference's sample -> loop -> append -> delete).

One job instead of a Python loop over batches: the sampled rows carry a
``batch_id``, every batch is augmented in the same job (the augmentation is
map-only), and results are appended to the target partitioned by ``batch_id``.
Nothing is deleted in place: rows whose key the target already holds are taken
out of the queue first, and batch ids go on after the target's last one, so a
run can be repeated (also after a failure) without losing or repeating rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagekit.operators.augment import augment
from passagekit.operators.sample import build_batches
from passagekit.sources.io import append_results, remove_processed, table_exists


def process_batches(queue: DataFrame, target: str, key: str, text: str = "text", n: int = 25,
                    batch_size: int = 100, num_batches: int = 100, seed: int = 0) -> DataFrame:
    """Augment about ``batch_size * num_batches`` pending queue rows; returns the
    rows still pending.  The processed rows (with ``questions`` and ``batch_id``)
    are appended to ``target``."""
    spark = queue.sparkSession
    pending, last = queue, 0
    if table_exists(spark, target):
        done = spark.read.parquet(target)
        pending = remove_processed(queue, done, [key])
        last = done.agg(F.coalesce(F.max("batch_id"), F.lit(0))).first()[0]
    batches = build_batches(pending, batch_size, num_batches, key, seed).drop("questions")
    batches = batches.withColumn("batch_id", F.col("batch_id") + F.lit(last).cast("int"))
    keep = [c for c in batches.columns if c != key]
    append_results(augment(batches, key=key, text=text, n=n, seed=seed, keep=keep).drop("n_questions"), target)
    return remove_processed(queue, spark.read.parquet(target), [key])
