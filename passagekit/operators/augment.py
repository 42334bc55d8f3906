"""Passage augmentation: candidates -> questions -> scores -> top-n -> one string.

All candidate rows stay distributed: ranking is ``row_number() <= n`` per
passage (partial WindowGroupLimit before the shuffle), the final string is
an ordered ``collect_list`` of at most n entries per passage.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagekit.functions.arrays import explode_rows
from passagekit.functions.text import trim_question
from passagekit.operators import models, textprep

#: characters of a question that is kept while a passage's candidates are compared
KEPT_CHARS = 1024


def generate_questions(cands: DataFrame, generator_factory=None, keep: list[str] | None = None,
                       items: list[str] | None = None) -> DataFrame:
    """Add ``question``.

    ``generator_factory()`` returns a callable that receives an Arrow batch of
    candidates as a pandas DataFrame (columns ``answer``, ``context``,
    ``style`` and ``prompt`` = '<answer> a <context> c', the seq2seq input of
    the reference) and returns one question per row -- a seq2seq model in
    production.  Default: the SQL stand-in, no Python.
    ``keep``: the columns that come back beside the question (all of them, if not
    given); a context is as long as a segment and comes once per sentence of it.
    ``items``: array columns (``answer`` among them) of rows that hold a candidate per
    element, so that a context travels once; the result has a row per candidate.
    """
    kept = cands.columns if keep is None else list(keep)
    if items and generator_factory is None:
        rows = explode_rows(cands, [c for c in cands.columns if c not in items], F.arrays_zip(*items), ["_item"])
        return generate_questions(rows.select(*(F.col("_item")[c].alias(c) if c in items else c for c in cands.columns)),
                                  None, kept)
    if generator_factory is None:
        return cands.withColumn("question", models.default_question(
            F.col("answer"), F.col("context"), F.col("style"))).select(*kept, "question")
    schema = T.StructType([T.StructField(c, cands.schema[c].dataType.elementType if c in (items or []) else
                                         cands.schema[c].dataType) for c in kept] + [T.StructField("question", T.StringType())])
    before, between = textprep.ANSWER_TOKEN + " ", " " + textprep.CONTEXT_TOKEN + " "

    def model():
        gen = generator_factory()

        def run(b: pd.DataFrame) -> pd.DataFrame:
            prompts = [None if a is None or c is None else before + a + between + c
                       for a, c in zip(b["answer"], b["context"])]
            return b[kept].assign(question=list(gen(b.assign(prompt=prompts))))
        return (lambda b: map(run, models.item_batches(b, items))) if items else run
    return models.apply_batches(cands, model, schema)


def score_pairs(qa: DataFrame, scorer_factory=None) -> DataFrame:
    """Add ``score`` for (question, correct answer); multiple-choice candidates
    are scored against the option flagged correct.  Without a column ``choices``
    every answer is the correct one."""
    right = models.correct_answer(F.col("answer"), F.col("choices")) if "choices" in qa.columns else F.col("answer")
    qa = qa.withColumn("_ans", right)
    if scorer_factory is None:
        return qa.withColumn("score", models.default_score(F.col("question"), F.col("_ans"))).drop("_ans")
    schema = T.StructType(list(qa.schema.fields) + [T.StructField("score", T.DoubleType())])

    def model():
        sc = scorer_factory()

        def run(b: pd.DataFrame) -> pd.DataFrame:
            return b.assign(score=list(sc(b["question"], b["_ans"])))
        return run
    return models.apply_batches(qa, model, schema).drop("_ans")


def rank_candidates(scored: DataFrame, n: int = 10, key: str = "doc_id") -> DataFrame:
    """Top ``n`` by score (ties: candidate order, like a stable sort); fewer if
    fewer candidates exist."""
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("cand_id").asc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def concat_questions(ranked: DataFrame, key: str = "doc_id", order: str = "rank") -> DataFrame:
    """``(key, questions, n_questions)``: trimmed questions joined in rank order."""
    items = F.struct(F.col(order).alias("o"), trim_question(F.col("question")).alias("q"))
    g = ranked.groupBy(key).agg(F.array_sort(F.collect_list(items)).alias("_l"))
    return g.select(key, F.array_join(F.transform("_l", lambda x: x["q"]), "").alias("questions"),
                    F.size("_l").alias("n_questions"))


def scored_array(df: DataFrame, key: str = "doc_id", text: str = "text", style: str = "all",
                 seed: int = 0, n: int | None = None) -> DataFrame:
    """Adds ``_scored``: array<struct<neg_score, cand_id, question, score>> per row, the default
    generator and scorer applied inside the row (no shuffle); the best ``n`` only, if given.

    A question can be as long as its text, so until the best are chosen a candidate refers
    to its answer and context; questions over ``KEPT_CHARS`` are put together again then.
    """
    d = textprep.with_parts(df, key, text, style, seed)

    def scored(p: Column, x: Column) -> Column:
        def found(question: Column) -> Column:
            score = models.default_score(question, models.correct_answer(x["answer"], x["choices"]))
            kept = F.when(F.length(question) <= KEPT_CHARS, question)
            return models._once(F.struct(score.alias("score"), kept.alias("kept")), lambda s: F.struct(
                (-s["score"]).alias("neg_score"), textprep.part_id(p, x).alias("cand_id"), s["score"].alias("score"),
                s["kept"].alias("kept"), x["answer"].alias("answer"), p["context"].alias("context"),
                p["style"].alias("style")))
        return models._once(models.default_question(x["answer"], p["context"], p["style"]), found)

    best = textprep.candidates_of(F.col("_parts"), scored)
    if n is not None:
        best = top_questions(best, n)
    return d.withColumn("_scored", F.transform(best, lambda c: F.struct(
        c["neg_score"].alias("neg_score"), c["cand_id"].alias("cand_id"),
        F.coalesce(c["kept"], models.default_question(c["answer"], c["context"], c["style"])).alias("question"),
        c["score"].alias("score")))).drop("_parts")


def top_questions(scored: Column, n: int) -> Column:
    """Best ``n`` by score, ties by candidate order (natural order of (-score, cand_id))."""
    return F.slice(F.sort_array(scored), 1, n)


def augment(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 10, style: str = "all",
            evaluate: bool = True, seed: int = 0, generator_factory=None, scorer_factory=None,
            keep: list[str] | None = None) -> DataFrame:
    """Generate up to ``n`` ranked questions per passage: ``(key, *keep, questions, n_questions)``.

    With the default models everything happens inside the passage's row
    (candidates, questions, scores, top-n, concatenation): a map-only job, and
    ``keep`` columns travel along, so no caller joins the result back.
    With pluggable models the candidates are exploded into rows for Arrow
    batches and ranked with ``row_number() <= n`` per passage.  With
    ``evaluate=False`` every candidate is kept, in candidate order.
    """
    kept = [c for c in keep or [] if c != key]
    if generator_factory is None and scorer_factory is None:
        source = df.select(*dict.fromkeys([key, text, *kept]))
        if evaluate:
            d = scored_array(source, key, text, style, seed, n).withColumnRenamed("_scored", "_top")
        else:
            d = textprep.with_parts(source, key, text, style, seed).withColumn("_top", textprep.candidates_of(
                F.col("_parts"), lambda p, x: F.struct(textprep.part_id(p, x).alias("cand_id"), models.default_question(
                    x["answer"], p["context"], p["style"]).alias("question"))))
        return d.select(key, *kept, F.array_join(F.transform("_top", lambda c: trim_question(c["question"])), "")
                        .alias("questions"), F.size("_top").alias("n_questions"))
    # only what the models read travels, a context once: numbers instead of the id, the correct option instead of all
    parts, rest = textprep.build_parts(df.select(key, text), key, text, style, seed)
    ids, items = ["_kind", "_part", "_item"], ["_item", "answer", "_right"]
    own = explode_rows(parts, [key], F.col("_parts"), ["_p"]).where(F.size("_p.items") > 0).select(
        key, F.col("_p.kind").alias("_kind"), F.col("_p.part").alias("_part"), "_p.style", "_p.context",
        F.transform("_p.items", lambda x: x["item"]).alias("_item"),
        F.transform("_p.items", lambda x: x["answer"]).alias("answer"),
        F.transform("_p.items", lambda x: models.correct_answer(x["answer"], x["choices"])).alias("_right"))
    rest = rest.select(
        key, F.col("cand_id.kind").alias("_kind"), F.col("cand_id.part").alias("_part"), "style", "context",
        F.array("cand_id.item").alias("_item"), F.array("answer").alias("answer"),
        F.array(models.correct_answer(F.col("answer"), F.col("choices"))).alias("_right"))
    qa = generate_questions(own.unionByName(rest), generator_factory, [key, *ids, "_right"], items).withColumnRenamed(
        "_right", "answer")
    cand_id = F.struct(*(F.col(i).alias(i[1:]) for i in ids))
    if evaluate:
        scored = score_pairs(qa, scorer_factory).withColumn("cand_id", cand_id)
        out = concat_questions(rank_candidates(scored, n, key), key, "rank")
    else:
        out = concat_questions(qa.withColumn("cand_id", cand_id), key, "cand_id")
    # every passage gets a value, '' when no candidate could be formed
    source = df.select(key, *kept) if kept else df.select(key).distinct()
    return source.join(out, key, "left").select(
        key, *kept, F.coalesce("questions", F.lit("")).alias("questions"),
        F.coalesce("n_questions", F.lit(0)).alias("n_questions"))
