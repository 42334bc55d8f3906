"""Retrieval evaluation: accuracy@k, failure lists, configuration grid.

One search at the largest k serves every k: a query is a hit at k when the
best rank of any passage of its gold document is <= k.  The reference ran
the whole search again for each k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_KS = (10, 20, 50, 100)


def best_gold_rank(hits: DataFrame, gold: DataFrame, q_key: str = "query_id",
                   doc: str = "doc_id", group: str | None = None) -> DataFrame:
    """``(q_key, best)``: lowest rank whose document is a gold one, NULL if none.

    Every gold query is kept (a query without hits is a miss).  ``gold`` may hold
    several documents per query: any of them is a hit.
    """
    keys = [group, q_key] if group else [q_key]
    g = gold.select(*keys, F.col(doc).alias("_gold")).distinct()
    matched = (hits.join(g, keys).where(F.col(doc) == F.col("_gold"))
               .groupBy(*keys).agg(F.min("rank").alias("best")))
    return g.select(*keys).distinct().join(matched, keys, "left")


def check_gold(gold: DataFrame, q_key: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """The gold rows of query sets with one document per query (the reference
    raised on duplicates): a query with several documents is an error, raised by
    the plan that reads the rows, not by a job of its own."""
    one = gold.groupBy(q_key).agg(F.min(doc).alias(doc), F.max(doc).alias("_other"))
    wrong = F.raise_error(F.concat(F.lit("query with several gold documents: "), F.col(q_key).cast("string")))
    return one.select(q_key, F.when(F.col(doc) == F.col("_other"), F.col(doc)).otherwise(
        wrong.cast(gold.schema[doc].dataType)).alias(doc))


def accuracy_at_k(hits: DataFrame, gold: DataFrame, ks=DEFAULT_KS, q_key: str = "query_id",
                  doc: str = "doc_id") -> DataFrame:
    """``(k, accuracy, n)`` with accuracy in percent, as the reference printed it."""
    best = best_gold_rank(hits, gold, q_key, doc)
    aggs = []
    for k in ks:
        aggs.append(F.sum(F.when(F.col("best") <= k, 1).otherwise(0)).alias(f"h{k}"))
    row = best.agg(F.count(F.lit(1)).alias("n"), *aggs)
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("h")) for k in ks]))
    out = row.select("n", stacked.alias("s"))
    return out.select(F.col("s.k").alias("k"),
                      F.round(F.col("s.h") * 100.0 / F.col("n"), 6).alias("accuracy"),
                      F.col("n"))


def failed_queries(hits: DataFrame, gold: DataFrame, k: int = 100, q_key: str = "query_id",
                   doc: str = "doc_id") -> DataFrame:
    """Queries without a gold document among the first k hits, with the
    documents that were returned instead (in rank order, comma separated).

    The hits are read once: joined to the (pre-collected) gold documents of their
    query, they give the best gold rank and the returned list together.
    """
    g = gold.groupBy(q_key).agg(F.collect_set(F.col(doc)).alias("_gold"))
    seen = F.struct("rank", F.col(doc).cast("string").alias("d"))
    found = (g.join(hits.where(F.col("rank") <= k), q_key, "left").groupBy(q_key)
             .agg(F.max(F.array_contains("_gold", F.col(doc)).cast("int")).alias("_hit"),
                  F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), seen))).alias("_r")))
    return found.where(F.coalesce("_hit", F.lit(0)) == 0).select(
        q_key, F.array_join(F.transform("_r", lambda x: x["d"]), ",").alias("returned"))


def accuracy_by_group(hits: DataFrame, gold: DataFrame, group: str = "config", ks=DEFAULT_KS,
                      q_key: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """``(group, k, accuracy, n)`` for hits and gold tagged with a group column."""
    best = best_gold_rank(hits, gold, q_key, doc, group)
    per = best.select(group, "best", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    return per.groupBy(group, "k").agg(
        F.round(F.sum(F.when(F.col("best") <= F.col("k"), 1).otherwise(0)) * 100.0 / F.count(F.lit(1)), 6)
        .alias("accuracy"),
        F.count(F.lit(1)).alias("n"))
