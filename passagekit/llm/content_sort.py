"""Exact de-duplication by sorting contents.

Rows are range-partitioned by sampled splitters and sorted inside partitions
(Spark's external sort) by (first characters, SHA-256, whole text, id), so equal
texts lie next to each other; the first two parts keep the splitters small, the
id lets a hot text spread over several partitions.  One pass over
each sorted partition compares neighbouring whole texts.  Runs that reach a
partition's edge are joined to the next partition's by comparing the edge texts
(two rows per partition), so no group is ever gathered in one task.

Defined cases: a NULL text counts as empty; ties and repeated rows: of equal
texts the last row in id order stays (NULL ids come first), exactly one per
text; an empty table gives an empty result; other columns are carried along if
named in ``carry`` and never clash otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from passagekit.llm.common import cut, map_batches

PREFIX_CHARS = 64
FOUND = ["_text_sha256", "_part", "_run", "_nth", "_edge"]


def sort_contents(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Equal texts adjacent, in id order, over range partitions in order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (df.withColumn("_prefix", F.substring(text, 1, PREFIX_CHARS))
            .withColumn("_text_sha256", F.sha2(text.cast("binary"), 256))
            .repartitionByRange("_prefix", "_text_sha256", id_col)
            .sortWithinPartitions("_prefix", "_text_sha256", text, id_col))


def find_runs(columns: list[str], text_col: str):
    """Numbers the runs of equal neighbouring texts of a sorted partition.

    Adds ``_run`` (from 0), ``_nth`` (place in the run) and, on the first and
    last row of the partition, ``_edge``: the text.  Only the previous row is
    held besides the batch.
    """
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        run, nth, last, held = -1, -1, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if held is not None:
                yield held
            text = pc.fill_null(batch.column(text_col), "")
            new = np.ones(n, dtype=bool)
            new[0] = last is None or not pc.equal(text[0], last).as_py()
            if n > 1:
                new[1:] = pc.not_equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            runs = run + np.cumsum(new)
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(new, at, -1))
            nths = np.where(start < 0, nth + 1 + at, at - start)
            edge = [None] * n
            if run < 0:
                edge[0] = text[0].as_py()
            run, nth, last = int(runs[-1]), int(nths[-1]), text[n - 1]
            held = pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), batch.column("_text_sha256"),
                 pa.array(np.full(n, part), pa.int32()), pa.array(runs, pa.int64()),
                 pa.array(nths, pa.int64()), pa.array(edge, pa.string())], [*columns, *FOUND])
        if held is not None:
            edge = [None] * held.num_rows
            edge[0], edge[-1] = held.column("_edge")[0].as_py(), last.as_py()
            yield held.set_column(held.num_columns - 1, "_edge", pa.array(edge, pa.string()))

    return step


def exact_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                     carry: list[str] | None = None) -> DataFrame:
    """Rows (id, *carry, keep_id, group_size, kept, text_sha256), one per input row."""
    columns = [id_col, *(c for c in carry or [] if c != id_col)]
    rows = df.select(*dict.fromkeys([*columns, text_col]))
    ordered = sort_contents(rows, text_col, id_col).select(*rows.columns, "_text_sha256")
    schema = StructType([*(df.schema[c] for c in columns), StructField("_text_sha256", StringType()),
                         StructField("_part", IntegerType()), StructField("_run", LongType()),
                         StructField("_nth", LongType()), StructField("_edge", StringType())])
    found = cut(map_batches(ordered, find_runs(columns, text_col), schema))

    runs = found.groupBy("_part", "_run").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.struct(F.col("_nth"), F.col(id_col))).alias("_top"))
    # which partitions begin with the text that ends the one before: two texts per partition
    edges = found.where(F.col("_edge").isNotNull())
    ends = edges.groupBy("_part").agg(
        F.min(F.struct("_run", "_nth", "_edge")).getField("_edge").alias("_first_text"),
        F.max(F.struct("_run", "_nth", "_edge")).alias("_last")).select(
        "_part", "_first_text", F.col("_last._run").alias("_last_run"), F.col("_last._edge").alias("_last_text"))
    in_order = Window.orderBy("_part")
    goes_on = F.coalesce(F.lag("_last_text").over(in_order) == F.col("_first_text"), F.lit(False))
    chain = ends.select("_part", "_last_run", goes_on.alias("_goes_on"),
                        F.lag("_part").over(in_order).alias("_before"),
                        F.lag("_last_run").over(in_order).alias("_before_run"))
    # the head of the chain that a partition's first run belongs to
    head = F.when(~F.col("_goes_on"), F.struct(F.col("_part").alias("p"), F.lit(0).cast("long").alias("r"))).when(
        F.col("_before_run") > 0, F.struct(F.col("_before").alias("p"), F.col("_before_run").alias("r")))
    heads = chain.withColumn("_head", F.last(head, ignorenulls=True).over(in_order)).where("_goes_on").select(
        "_part", F.lit(0).cast("long").alias("_run"), "_head")
    named = runs.join(heads, ["_part", "_run"], "left").withColumn(
        "_head", F.coalesce("_head", F.struct(F.col("_part").alias("p"), F.col("_run").alias("r"))))
    groups = named.groupBy("_head").agg(
        F.sum("_n").alias("_size"), F.max(F.struct("_part", "_run", "_top")).alias("_end"))
    totals = named.select("_part", "_run", "_head").join(groups, "_head").select(
        "_part", "_run", "_size", "_end")
    keep = F.col(f"_end._top.{id_col}")
    return found.drop("_edge").join(totals, ["_part", "_run"]).select(
        *columns, keep.alias("keep_id"), F.col("_size").alias("group_size"),
        ((F.col("_end._part") == F.col("_part")) & (F.col("_end._run") == F.col("_run"))
         & (F.col("_end._top._nth") == F.col("_nth"))).alias("kept"),
        F.col("_text_sha256").alias("text_sha256"))
