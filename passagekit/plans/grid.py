"""Retrieval evaluation grid over the corpus-building dimensions.

Configurations = corpus (``gold``: answer passages and their document
siblings, stages 1-2; ``wiki``: plus the sampled noise, stage 3) x concat
level (1, 2, 3) x generated questions (``qg``/``no_qg``) x title in the
passage template.  Distinct texts are encoded in one Arrow-batch pass; the
vectors of each stage are searched once, in one grouped k-NN job over all
variants, and the hits of the larger corpus are merged from both; one aggregate
yields accuracy@k.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.operators import augment, evaluate, models, textprep, vectors
from passagekit.operators.curate import group_positions
from passagekit.operators.hits import merge_hits
from passagekit.operators.sample import row_index
from passagekit.plans import corpus, fixtures
from passagekit.session import checkpoint_dir, collect_finished
from passagekit.sources.io import read_table, update_from

CORPORA = (("gold", 2), ("wiki", 3))
VARIANTS = [(qg, title) for qg in (False, True) for title in (True, False)]


def _settled(df: DataFrame) -> DataFrame:
    """Stored by a checkpoint; the files of finished steps go, as a grid has many of them."""
    out = df.checkpoint()
    del df
    collect_finished(out.sparkSession)
    return out


def corpus_with_questions(spark: SparkSession, sf_dir: str, levels=(1, 2, 3), n: int = 25,
                          seed: int = 0) -> DataFrame:
    """Corpora of all levels (``level`` column); gold passages augmented once
    (one augment job over the gold texts of every level) and updated in place."""
    checkpoint_dir(spark)
    # read by the builder of every level: curate each corpus and number its passages once
    nq, wiki = (_settled(group_positions(fixtures.corpus_passages(spark, sf_dir, english), "doc_id", ["src", "num"]))
                for english in (True, False))
    answers = fixtures.answers(spark, sf_dir)
    # a level is stored before the next one is built: its groups, copies of all texts, go
    allc = None
    for lv in levels:
        part = _settled(corpus.build_corpus(nq, wiki, answers, lv, seed=seed).withColumn("level", F.lit(lv)))
        allc = part if allc is None else allc.unionByName(part)
    del nq, wiki, answers
    collect_finished(spark)
    keys = ["level", "doc_id", "title", "text"]
    todo = (allc.where(F.col("stage") == 1).select(*keys).distinct()
            .withColumn("_k", F.md5(F.concat_ws("\x1f", *keys))))
    updates = augment.augment(todo, key="_k", text="text", n=n, seed=seed, keep=keys).select(*keys, "questions")
    return update_from(allc, updates, keys, ["questions"])


def config_name(corpus_name: str, qg: bool, title: bool):
    return F.concat(F.lit(corpus_name + "_"), F.col("level").cast("string"),
                    F.lit("_" + ("qg" if qg else "no_qg") + ("" if title else "_no_title")))


def retrieval_grid(spark: SparkSession, sf_dir: str, levels=(1, 2, 3), k: int = 100, seed: int = 0,
                   ks=evaluate.DEFAULT_KS) -> DataFrame:
    checkpoint_dir(spark)
    c = _settled(corpus_with_questions(spark, sf_dir, levels, seed=seed))
    # the corpora of one variant differ in their noise only: a variant is built and numbered once
    variants = []
    for qg, title in VARIANTS:
        parts = (["title"] if title else []) + ["text"] + (["questions"] if qg else [])
        v = textprep.compose_passage(c, parts)
        variants.append(v.select(config_name("", qg, title).alias("variant"), "stage",
                                 "doc_id", "corpus_ids", "query_id", "passage"))
    src = variants[0]
    for v in variants[1:]:
        src = src.unionByName(v)
    # every distinct passage text is encoded once, whatever number of configurations use it
    texts = models.encode(src.select(F.md5("passage").alias("text_key"), "passage").distinct(), "text_key", "passage")
    rows = src.withColumn("text_key", F.md5("passage")).drop("passage").join(texts, "text_key")
    index = row_index(rows, ["variant", "corpus_ids", F.col("query_id").asc_nulls_first()], "vec_id")

    gold = (c.where(F.col("stage") == 1).select("level", "query_id", "doc_id").distinct())
    wanted = [gold.select(config_name("", qg, title).alias("variant"),
                          F.substring("query_id", 2, 20).cast("long").alias("query_id"), "doc_id") for qg, title in VARIANTS]
    wanted = reduce(DataFrame.unionByName, wanted).checkpoint()
    b = read_table(spark, f"{sf_dir}/benchmark.parquet", ["item_id", "text"])
    qv = models.encode(b, "item_id", "text").withColumnRenamed("item_id", "query_id")
    queries = wanted.select("variant", "query_id").distinct().join(qv, "query_id").checkpoint()
    # every vector is searched once: the hits of a corpus with noise are those without, merged with the noise's
    found, parts = None, []
    for (corpus_name, last), (_, before) in zip(CORPORA, (("", 0), *CORPORA)):
        added = index.where((F.col("stage") > before) & (F.col("stage") <= last))
        new = vectors.knn(queries, added, k, group="variant")
        found = _settled(new if found is None else merge_hits([found, new], k, group="variant"))
        parts.append(found.withColumn("config", F.concat(F.lit(corpus_name), "variant")))
    hits = reduce(DataFrame.unionByName, parts).join(index.select("vec_id", "doc_id"), "vec_id")
    gold_cfg = reduce(DataFrame.unionByName, [
        wanted.withColumn("config", F.concat(F.lit(name), "variant")) for name, _ in CORPORA])
    return evaluate.accuracy_by_group(hits.drop("variant"), gold_cfg.drop("variant"), "config", ks)
