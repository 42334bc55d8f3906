"""Reference-shaped tables derived from the driver tables.

The reference reads NQ / Wikipedia passage tables; the driver provides
``documents``, ``benchmark``, ``embeddings``, ``conversations`` and
``labels``.  These views map one onto the other, always over whole tables:

* ``passages_raw``  -- one row per line of a document, identified by
  (``src``, ``num``) = (document, line) and ``corpus_id`` = 'doc<src>_<num>';
  title = the document's whole first line, which also stands in front of every
  passage text, as in a raw dump (copied documents share titles).
* ``passages``      -- doc ids by title, prefix strip (which gives every line
  back complete), NULL title repair.
* ``queries``       -- benchmark items, ``query_id`` = 'q' || item_id.
* ``answers``       -- gold passages: for every document that contains the
  benchmark text, the line in which its first occurrence starts.
* ``corpus_passages`` -- two corpora (answer corpus / noise corpus) split
  by a data attribute (English vs other documents), not by id.
* ``qa_pairs``      -- a user turn and the assistant turn that follows it.

Files with too few input splits for CPU-heavy text work (one large file) are
spread by document id when the session sets ``spark.passagekit.spread.input`` to
true; the default reads tables as they are laid out.  The queries on sentences and
candidates of ``catalog`` always spread theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.functions.arrays import explode_rows
from passagekit.operators.curate import curate_passages
from passagekit.operators.occurrences import occurrence_lines
from passagekit.session import checkpoint_dir
from passagekit.sources.io import read_table

PASSAGE = ["doc_id", "corpus_id", "src", "num", "title", "text"]


def documents(spark: SparkSession, sf_dir: str, cols=None) -> DataFrame:
    spread = spark.conf.get("spark.passagekit.spread.input", "false") == "true"
    return read_table(spark, f"{sf_dir}/documents.parquet", cols, spread_by="doc_id" if spread else None)


def passage_id(src, num):
    return F.concat(F.lit("doc"), src.cast("string"), F.lit("_"), num.cast("string"))


def passages_raw(spark: SparkSession, sf_dir: str, where=None) -> DataFrame:
    """``where``: optional predicate on the documents table, applied in the scan
    (Parquet filter pushdown) before the lines are exploded."""
    docs = documents(spark, sf_dir)
    if where is not None:
        docs = docs.where(where)
    lines = explode_rows(docs.select("doc_id", "text"), [
        F.col("doc_id").alias("src"), F.substring_index("text", "\n", 1).alias("title")],
        F.split("text", "\n", -1), ["num", "line"])
    text = F.when(F.length("title") > 0, F.concat("title", F.lit(" "), "line")).otherwise(F.col("line"))
    return lines.select("src", "num", passage_id(F.col("src"), F.col("num")).alias("corpus_id"), "title",
                        text.alias("text"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, corpus_id, src, num, title, text`` with ids 'd_<dense rank of title>'."""
    return curate_passages(passages_raw(spark, sf_dir), prefix="d_").select(*PASSAGE)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read_table(spark, f"{sf_dir}/benchmark.parquet", ["item_id", "text"])
    return b.select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"), "text")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, item_id, src, corpus_id``: the passages in which an occurrence of the query's text starts."""
    docs = documents(spark, sf_dir, ["doc_id", "text"])
    b = read_table(spark, f"{sf_dir}/benchmark.parquet", ["item_id", "text"])
    checkpoint_dir(spark)
    gold = occurrence_lines(docs, b).checkpoint()  # read by several stages of the corpus builder
    return gold.select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"), "item_id",
                       F.col("doc_id").alias("src"), passage_id(F.col("doc_id"), F.col("line")).alias("corpus_id"))


def corpus_passages(spark: SparkSession, sf_dir: str, english: bool) -> DataFrame:
    """Curated passages of English (answer corpus, ids 'd_') or of the other
    documents (noise corpus, ids 'wikidoc_'); ids are ranked per corpus."""
    cond = F.col("lang") == "en" if english else ~(F.col("lang") == "en")
    raw = passages_raw(spark, sf_dir, where=cond)
    return curate_passages(raw, prefix="d_" if english else "wikidoc_").select(*PASSAGE)


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, f"{sf_dir}/conversations.parquet", ["conv_id", "turn", "role", "text"])
    user = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    bot = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return user.join(bot, ["conv_id", "turn"])
