"""Incremental augmentation with Structured Streaming.

The reference used a warehouse table as a work queue: several sessions
sampled batches, appended results and deleted the processed rows, with no
locking.  Here the queue is a folder of Parquet files read by a file
stream: the stream checkpoint records which files were processed (no
delete, no double processing), ``trigger(availableNow=True)`` drains what
is there and stops, and every micro-batch is written to its own
``batch_id=<epoch>`` folder with dynamic partition overwrite, so a replayed
epoch after a failure replaces its own output instead of duplicating it.
Rows already present in the target (same key) are skipped.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.operators.augment import augment
from passagekit.session import checkpoint_dir
from passagekit.sources.io import table_exists


def stream_augment(spark: SparkSession, in_dir: str, out_dir: str, ckpt: str, schema,
                   key: str = "doc_id", text: str = "text", n: int = 25, seed: int = 0,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Drain the queue folder once; returns the target table."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    queue = reader.parquet(in_dir)

    def process(batch: DataFrame, epoch_id: int) -> None:
        # a key that arrives twice in one micro-batch is processed once
        others = [c for c in batch.columns if c != key]
        pending = batch.dropDuplicates([key])
        if table_exists(spark, out_dir):
            # rows of this epoch are being replaced (a replay), so they do not count as done
            done = spark.read.parquet(out_dir).where(F.col("batch_id") != epoch_id).select(key)
            pending = pending.join(done, key, "left_anti")
        out = augment(pending, key=key, text=text, n=n, seed=seed, keep=others).withColumn(
            "batch_id", F.lit(epoch_id))
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(out_dir))

    q = (queue.writeStream.foreachBatch(process).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out_dir)


def queue_from(df: DataFrame, base: str, parts: int = 2, key: str = "doc_id") -> str:
    """Write a queue table as ``parts`` arrival files (hash split) under ``base``."""
    in_dir = os.path.join(base, "queue")
    df.withColumn("_arrival", F.pmod(F.xxhash64(F.col(key)), F.lit(parts))).write.mode(
        "overwrite").partitionBy("_arrival").parquet(in_dir)
    return in_dir


def run_incremental(spark: SparkSession, queue_df: DataFrame, key: str, text: str, n: int = 25,
                    seed: int = 0) -> DataFrame:
    """Queue -> files in the shared checkpoint folder -> drained stream -> target."""
    base = os.path.join(checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    in_dir = queue_from(queue_df, base, key=key)
    schema = spark.read.parquet(in_dir).schema  # includes the _arrival partition column
    return stream_augment(spark, in_dir, os.path.join(base, "target"), os.path.join(base, "ckpt"),
                          schema, key=key, text=text, n=n, seed=seed)
