"""A stored dictionary of titles whose ids never change.

``curate.dense_index`` numbers the titles of one table; a later dump with new
titles would number all of them again.  Here a load only appends: titles that the
dictionary does not hold get the ids after its last one, in their own order, and
one commit makes the load visible.  Ids have no gap and no clash; a load that
failed before its commit leaves nothing behind that is read.  NULL is a title like
any other (first in order).  One load at a time.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.operators.curate import dense_index
from passagekit.sources.events import commit, events

LOG = "load int, folder string, ids long"


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(title, title_id, load): all committed loads."""
    loads = [r["folder"] for r in events(spark, path, LOG).collect()]
    schema = "title string, title_id long, load int"
    return spark.read.schema(schema).parquet(*loads) if loads else spark.createDataFrame([], schema)


def extend_dictionary(titles: DataFrame, path: str, title: str = "title") -> DataFrame:
    """Adds the titles that are new; returns the whole dictionary."""
    spark = titles.sparkSession
    log = events(spark, path, LOG).agg(F.max("load"), F.coalesce(F.sum("ids"), F.lit(0))).first()
    load, held = (log[0] or 0) + 1, log[1]
    known = read_dictionary(spark, path).select(F.col("title").alias("_known"))
    asked = titles.select(F.col(title).alias("title")).distinct()
    new = asked.join(known, asked["title"].eqNullSafe(known["_known"]), "left_anti")
    numbered = dense_index(new, "title", "_rank").select(
        "title", (F.col("_rank") + F.lit(held)).cast("long").alias("title_id"), F.lit(load).alias("load"))
    folder = f"{path}/data/{load}-{uuid4().hex}"
    numbered.write.parquet(folder)
    commit(spark, path, [(load, folder, spark.read.parquet(folder).count())], LOG)
    return read_dictionary(spark, path)
