"""Stored tables that can be updated and deleted from (copy on write).

Rows live in buckets by the hash of their key.  A change reads and rewrites the
buckets that hold a changed key, into a new folder; then one commit names the
folders of the new version.  Untouched buckets keep their files.  A failure before
the commit leaves the old version in place.  One writer at a time; readers always
see a whole version.

Only bucket numbers and folder names pass through the driver.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from passagekit.sources.events import commit, events
from passagekit.sources.io import remove_processed, update_from

BUCKET = "__bucket"
LOG = "version int, bucket int, folder string, keys string, buckets int, schema string"


class BucketTable:
    """A table in the folder ``path``, keyed by ``keys`` (NULL keys are allowed and share a bucket)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: list[str], buckets: int = 64) -> "BucketTable":
        """``CREATE TABLE AS SELECT``; replaces the content of an existing table in one commit."""
        table = cls(df.sparkSession, path)
        last = table._log().agg(F.max("version")).first()[0] or 0
        table._put(df, last + 1, keys, buckets, [])
        return table

    def _log(self) -> DataFrame:
        return events(self.spark, self.path, LOG)

    def _version(self) -> tuple[int, dict[int, list[str]], list[str], int, StructType]:
        log = self._log()
        rows = log.join(log.agg(F.max("version").alias("version")), "version").collect()
        if not rows:
            raise ValueError(f"no table in {self.path}")
        folders: dict[int, list[str]] = {}
        for r in rows:
            folders.setdefault(r["bucket"], []).extend([r["folder"]] if r["folder"] else [])
        first = rows[0]
        from json import loads

        return (first["version"], folders, loads(first["keys"]), first["buckets"],
                StructType.fromJson(loads(first["schema"])))

    def files(self) -> dict[int, list[str]]:
        """Folders of every bucket of the current version."""
        return {b: f for b, f in self._version()[1].items() if f}

    def _bucket(self, keys: list[str], buckets: int):
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _write(self, df: DataFrame, keys: list[str], buckets: int) -> dict[int, str]:
        """Writes the rows bucket by bucket into a new folder; the buckets that got rows."""
        base = f"{self.path}/data/{uuid4().hex}"
        df.withColumn(BUCKET, self._bucket(keys, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(base)
        found = self.spark.read.schema(f"{BUCKET} int").parquet(base).select(BUCKET).distinct().collect()
        return {r[0]: f"{base}/{BUCKET}={r[0]}" for r in found}

    def _put(self, df: DataFrame, version: int, keys: list[str], buckets: int, kept: list[tuple[int, str]]) -> None:
        from json import dumps

        rows = kept + list(self._write(df, keys, buckets).items())
        about = (dumps(keys), buckets, df.schema.json())
        commit(self.spark, self.path, [(version, b, f, *about) for b, f in rows or [(0, "")]], LOG)

    def _load(self, folders: list[str], schema: StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def read(self) -> DataFrame:
        _, folders, _, _, schema = self._version()
        return self._load([f for b in sorted(folders) for f in folders[b]], schema)

    def _rewrite(self, changes: DataFrame, change) -> None:
        """Rewrites the buckets that hold a key of ``changes``: their rows become ``change(rows)``."""
        version, folders, keys, buckets, schema = self._version()
        typed = changes.select(*(F.col(k).cast(schema[k].dataType) for k in keys))
        touched = {r[0] for r in typed.select(self._bucket(keys, buckets).alias("b")).distinct().collect()}
        old = self._load([f for b in touched for f in folders.get(b, [])], schema)
        kept = [(b, f) for b, fs in folders.items() if b not in touched for f in fs]
        self._put(change(old, keys), version + 1, keys, buckets, kept)

    def update(self, updates: DataFrame, cols: list[str]) -> None:
        """``UPDATE ... SET cols FROM updates``: one row of updates per key at most, else the job fails."""
        self._rewrite(updates, lambda old, keys: update_from(old, updates, keys, cols))

    def delete(self, done: DataFrame) -> None:
        """Deletes the rows whose whole key is in ``done``."""
        self._rewrite(done, lambda old, keys: remove_processed(old, done, keys))

    def append(self, df: DataFrame) -> None:
        """``INSERT INTO``: new files beside the old ones, nothing is rewritten."""
        version, folders, keys, buckets, schema = self._version()
        kept = [(b, f) for b, fs in folders.items() for f in fs]
        rows = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))
        self._put(rows, version + 1, keys, buckets, kept)
