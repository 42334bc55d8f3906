"""A small log of commits beside a table's files.

A commit is one Parquet file in a folder of its own (sessions that commit at the
same time do not meet), so readers see all of it or nothing; what a failed job has
written before its commit is never referred to.  The log holds a few rows per
commit (buckets, ranges or folders), never data.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def commit(spark: SparkSession, path: str, rows: list[tuple], schema: str) -> None:
    """Add the rows to the log as one file."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/log/{uuid4().hex}")


def events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All committed rows (none, if there is no log yet)."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true")
    try:
        return reader.parquet(f"{path}/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
