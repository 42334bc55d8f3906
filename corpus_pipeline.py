"""A training-data pipeline over ``documents``: each stage is written as Parquet and read by the next.

Every stage but the last returns the columns of its input.  Inside a stage the
columns have plain numbers for names, so extra columns never clash with the
operators' own.  An empty table runs through all stages; NULL texts count as
empty and leave at language ID (they have no letter).
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.llm import content_sort, langid, minhash, packing, toxicity
from passagekit.llm.common import held_out
from passagekit.llm.queries import word_bpe
from passagekit.session import checkpoint_dir


def numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """The documents with columns c0, c1 ...; and the names of their text and id."""
    names = docs.columns
    return docs.toDF(*(f"c{k}" for k in range(len(names)))), f"c{names.index('text')}", f"c{names.index('doc_id')}"


def named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Back to the documents' own columns."""
    return rows.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; learned from the labels of this stage's own documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs.select("doc_id", "text"), labels, ~held_out("doc_id", 5, 0))
    rows, text, _ = numbered(docs)
    return named(toxicity.score(rows, model, text, carry=rows.columns).where("predicted = 0"), docs)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or with an ambiguous language go."""
    model = langid.fit(docs.select("doc_id", "text", "lang"), ~held_out("doc_id", 3, 1))
    rows, text, _ = numbered(docs)
    return named(langid.predict(rows, model, text, carry=rows.columns).where(
        "lang_pred <> 'und' AND NOT ambiguous"), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    rows, text, key = numbered(docs)
    return named(content_sort.exact_duplicates(rows, text, key, carry=rows.columns).where("kept"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of every near-duplicate component stays."""
    rows, text, key = numbered(docs)
    kept = minhash.near_duplicates(rows.select(text, key), text, key).where("kept").select(
        F.col(key).alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    same = F.col(key).eqNullSafe(F.col("kept_id")) & (
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("kept_hash"))
    return named(rows.join(kept, same, "left_semi"), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all kept documents in sequences of 4096 tokens."""
    rows, text, key = numbered(docs)
    return packing.pack(rows.select(text, key), word_bpe(), text, key).withColumnRenamed(key, "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("exact_dedup", drop_copies),
    ("minhash_dedup", drop_near_copies),
    ("packing", pack),
]

#: Tokenizers, trained models and MinHash components are beyond SQL; tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, written and read again in the shared folder between them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(path := f"{folder}/{k}-{name}")
            docs = spark.read.parquet(path)
    return docs
