"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.session import bound_batches, checkpoint_dir, collect_finished, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (NULL for a NULL id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(mod)


def held_out(id_col: str, mod: int, rest: int) -> Column:
    """True for rows never learned from; a NULL id counts as held out."""
    return F.coalesce(remainder(id_col, mod) == F.lit(rest), F.lit(True))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder (survives lost executors)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """``cut``, and the files of finished steps go.

    Spark deletes the files of a shuffle or checkpoint when the driver collects the
    objects that stand for them, which many short steps in a row may all be done before;
    here it collects them at every cut.  Python lets go of a frame about a second after
    its last name, so a step's own files go at a later cut.
    """
    out = cut(df)
    del df
    collect_finished(out.sparkSession)
    return out


def map_batches(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped to the executors and batches of bounded size."""
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.mapInArrow(step, schema)


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; NULL becomes the empty text."""
    return [x or "" for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str | int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Re-slice batches so that one slice holds about ``most_bytes`` of ``column`` (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        group = (np.cumsum(size) - size) // most_bytes
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
