"""Sources and sinks (tables as Parquet folders).

The reference moves data between a warehouse and pandas frames; here every
table is a Parquet folder read and written by Spark, so nothing passes
through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_table(spark: SparkSession, path: str, cols: list[str] | None = None,
               spread_by: str | list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """``SELECT cols FROM table``; the projection reaches the Parquet scan.

    ``spread_by``: hash-partition the rows on that key (or keys) right after the scan.
    For CPU-heavy work on whole texts over files with too few input splits (one
    large file); the caller decides, nothing depends on the table's size.
    """
    df = spark.read.parquet(path)
    if cols:
        df = df.select(*cols)
    if spread_by:
        keys = [spread_by] if isinstance(spread_by, str) else spread_by
        df = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return df


def ingest_corpus(spark: SparkSession, path: str, fmt: str = "json",
                  schema: StructType | None = None, **options) -> DataFrame:
    """Load a raw corpus download (json lines, csv, tsv or parquet) with a declared schema."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "tsv":
        reader = reader.option("sep", "\t").option("header", options.pop("header", "true"))
        fmt = "csv"
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.format(fmt).load(path)


def ingest_with_rejects(spark: SparkSession, path: str, fmt: str, schema: StructType,
                        **options) -> tuple[DataFrame, DataFrame]:
    """``(table, rejects)``: records that fit the declared schema, and (file, record) of those that do not.

    json lines, csv or tsv.  A broken record never ends the load and never enters
    the table with half of its columns.  The parsed records are checkpointed, so
    both results come from one reading of the files.
    """
    from passagekit.session import checkpoint_dir

    checkpoint_dir(spark)
    held = "_rejected_record"
    whole = StructType([*schema.fields, StructField(held, StringType())])
    rows = ingest_corpus(spark, path, fmt, whole, mode="PERMISSIVE", columnNameOfCorruptRecord=held, **options)
    rows = rows.withColumn("_rejected_file", F.col("_metadata.file_name")).checkpoint()
    return (rows.where(F.col(held).isNull()).drop(held, "_rejected_file"),
            rows.where(F.col(held).isNotNull()).select(F.col("_rejected_file").alias("file"), F.col(held).alias("record")))


def save_table(df: DataFrame, path: str, mode: str = "overwrite",
               partition_by: list[str] | None = None) -> None:
    """``CREATE TABLE ... AS SELECT`` -> Parquet folder."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def append_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """``INSERT INTO`` -> append files to the folder."""
    save_table(df, path, mode="append", partition_by=partition_by)


def append_results(df: DataFrame, path: str) -> None:
    """Append an enriched batch, one folder per ``batch_id``."""
    save_table(df, path, mode="append", partition_by=["batch_id"] if "batch_id" in df.columns else None)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Is there a stored table?  Only existence is asked: unreadable tables still fail when read."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # no folder, or an empty one
            return False
        raise
    return True


def write_index(vectors: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Vector table ``(vec_id, key, doc_id, embedding, origin)``; the id map is a column."""
    save_table(vectors, path, mode=mode)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_id_map(vectors: DataFrame, path: str) -> None:
    """Position -> document map as JSON lines (for tools that want a side file)."""
    vectors.select(F.to_json(F.struct(F.col("vec_id").cast("string").alias("pos"),
                                      "doc_id")).alias("value")).write.mode("overwrite").text(path)


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """The exported map as ``(vec_id, doc_id)``."""
    row = F.from_json("value", "pos string, doc_id string")
    return spark.read.text(path).select(row.alias("r")).select(
        F.col("r.pos").cast("long").alias("vec_id"), F.col("r.doc_id").alias("doc_id"))


def remove_processed(pending: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Queue rows not yet processed: anti-join on the *pair* of keys.

    The reference deleted rows whose doc_id was in one list and whose text
    was in another, which can remove unprocessed rows; keys match together here.
    """
    return pending.join(done.select(*keys).distinct(), keys, "left_anti")


def update_from(target: DataFrame, updates: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """``UPDATE target SET cols = u.cols FROM updates u WHERE keys equal``.

    NULL keys never match (SQL equality).  Like the warehouse, a target row
    that matches two update rows is an error; the check is part of the plan
    (``raise_error`` on the matched row), not a separate job.  Updates are
    reduced to one row per key with a partial aggregate before the join.
    """
    agg = updates.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(f"_new_{c}") for c in cols])
    j = target.join(agg, keys, "left")
    out = j
    for c in cols:
        new = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"UPDATE matched a target row more than once (keys {keys})"))
                     ).otherwise(F.col(f"_new_{c}"))
        out = out.withColumn(c, F.when(F.col("_n").isNotNull(), new).otherwise(F.col(c)))
    return out.select(*target.columns)
