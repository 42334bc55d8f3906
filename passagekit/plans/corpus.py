"""Sample corpus builder (one per concat level).

Stage 1  gold groups: collapsed groups holding an answer passage, with the query id.
Stage 2  up to ``per_doc`` other groups of every answer document (deduplicated,
         gold groups excluded, reproducible random choice).
Stage 3  noise: groups of the other corpus whose title does not occur in the
         answer corpus (NOT IN semantics), deduplicated, sampled at ``rate``.

Differences to the warehouse SQL (all deliberate, see README): the id array
is carried along instead of joined back on (text, title), which could fan
out; gold groups are excluded at the same concat level; randomness is a key
hash with a seed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagekit.operators.coverage import not_in
from passagekit.operators.curate import collapse_passages, dedup_passages
from passagekit.operators.sample import sample_per_group, sample_rate
from passagekit.session import checkpoint_dir

# Noise rates of the three concat levels.
NOISE_RATE = {1: 0.0075, 2: 0.0143, 3: 0.02}

COLUMNS = ["stage", "query_id", "doc_id", "title", "text", "corpus_ids", "questions"]


ORDER = ["src", "first_num"]


def grouped(passages: DataFrame, level: int) -> DataFrame:
    g = collapse_passages(passages, level, series="src", positions="pos" if "pos" in passages.columns else None)
    return g.withColumn("corpus_ids", F.array_join("corpus_id_array", ","))


def gold_groups(groups: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, doc_id, src, first_num): groups that contain an answer passage."""
    ids = groups.select("doc_id", *ORDER, F.explode("corpus_id_array").alias("corpus_id"))
    return ids.join(answers.select("query_id", "corpus_id"), "corpus_id").select(
        "query_id", "doc_id", *ORDER).distinct()


def build_corpus(answer_passages: DataFrame, noise_passages: DataFrame, answers: DataFrame,
                 level: int, rate: float | None = None, per_doc: int = 5, seed: int = 0) -> DataFrame:
    rate = NOISE_RATE[level] if rate is None else rate
    # four consumers below: store once in the shared checkpoint folder (lineage cut)
    checkpoint_dir(answer_passages.sparkSession)
    groups = grouped(answer_passages, level).checkpoint()
    gold = gold_groups(groups, answers).checkpoint()  # one row per gold group; three consumers
    typed_null = F.lit(None).cast("string")

    stage1 = gold.join(groups, ["doc_id", *ORDER]).select(
        F.lit(1).alias("stage"), "query_id", "doc_id", "title", F.col("doc_text").alias("text"),
        "corpus_ids", typed_null.alias("questions"))

    answer_docs = gold.select("doc_id").distinct()
    # copies of a group count once; then groups that are gold themselves are left out
    cand = dedup_passages(groups.join(answer_docs, "doc_id", "left_semi"), ["doc_id", "title", "doc_text"], ORDER)
    cand = cand.join(gold, ["doc_id", *ORDER], "left_anti")
    stage2 = sample_per_group(cand, "doc_id", per_doc, "corpus_ids", seed=seed).select(
        F.lit(2).alias("stage"), typed_null.alias("query_id"), "doc_id", "title",
        F.col("doc_text").alias("text"), "corpus_ids", typed_null.alias("questions"))

    noise = not_in(grouped(noise_passages, level), "title", answer_passages, "title")
    noise = dedup_passages(noise, ["doc_id", "title", "doc_text"], ORDER)
    stage3 = sample_rate(noise, rate, "corpus_ids", seed=seed).select(
        F.lit(3).alias("stage"), typed_null.alias("query_id"), "doc_id", "title",
        F.col("doc_text").alias("text"), "corpus_ids", typed_null.alias("questions"))

    return stage1.unionByName(stage2).unionByName(stage3).select(*COLUMNS)
