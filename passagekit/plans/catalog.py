"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver tables (or data Spark derives from them) as
whole tables.  Results are flat scalars (arrays are joined to strings) so
that an independent SQL engine can compare them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.functions.arrays import explode_rows
from passagekit.operators import (
    augment, coverage, curate, evaluate, hits as hit_tables, keywords, models, pruned, sample, textprep, vectors)
from passagekit.operators.dictionary import extend_dictionary
from passagekit.plans import claims, corpus, fixtures
from passagekit.session import checkpoint_dir
from passagekit.sources import io
from passagekit.sources.buckets import BucketTable
from passagekit.sources.io import read_table

CATALOG: dict = {}


def register(name):
    def deco(fn):
        CATALOG[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- vectors
def _vector_inputs(spark: SparkSession, sf_dir: str, unit: bool = False):
    e = read_table(spark, f"{sf_dir}/embeddings.parquet", ["vec_id", "embedding", "label"])
    if unit:
        e = vectors.normalize(e)
    index = e.select("vec_id", F.col("label").cast("string").alias("doc_id"), "embedding")
    queries = e.select(F.col("vec_id").alias("query_id"), "embedding")
    gold = e.select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("doc_id"))
    return queries, index, gold


def _leave_one_out_hits(spark, sf_dir, k, unit=False):
    queries, index, gold = _vector_inputs(spark, sf_dir, unit)
    return vectors.knn(queries, index, k, exclude_self=True, keep=["doc_id"]), gold


@register("knn_top10")
def q_knn_top10(spark, sf_dir):
    """Exact 10-NN of every embedding among all others (squared L2)."""
    queries, index, _ = _vector_inputs(spark, sf_dir)
    hits = vectors.knn(queries, index, 10, exclude_self=True)
    return hits.select("query_id", "rank", "vec_id", F.round("d2", 6).alias("d2"))


@register("knn_pruned")
def q_knn_pruned(spark, sf_dir):
    """The same exact 10-NN, visiting only cells whose bound can be reached."""
    queries, index, _ = _vector_inputs(spark, sf_dir)
    hits, _ = pruned.knn_pruned(queries, index, 10, exclude_self=True)
    return hits.select("query_id", "rank", "vec_id", F.round("d2", 6).alias("d2"))


@register("knn_blocked")
def q_knn_blocked(spark, sf_dir):
    """The same exact 10-NN forced onto a fine grid (128 x 128 vectors per cell):
    many cells per query, merged by the per-query group limit."""
    queries, index, _ = _vector_inputs(spark, sf_dir)
    hits = vectors.knn(queries, index, 10, exclude_self=True, q_block_rows=128, x_block_rows=128)
    return hits.select("query_id", "rank", "vec_id", F.round("d2", 6).alias("d2"))


@register("accuracy_at_k")
def q_accuracy_at_k(spark, sf_dir):
    """Leave-one-out retrieval: a hit when a same-label vector is in the top k."""
    hits, gold = _leave_one_out_hits(spark, sf_dir, 100)
    return evaluate.accuracy_at_k(hits, evaluate.check_gold(gold))


@register("failed_queries")
def q_failed_queries(spark, sf_dir):
    hits, gold = _leave_one_out_hits(spark, sf_dir, 10)
    return evaluate.failed_queries(hits, evaluate.check_gold(gold), k=10)


@register("evaluate_grid")
def q_evaluate_grid(spark, sf_dir):
    """Two index variants (raw / unit-length vectors) searched in one grouped k-NN job."""
    parts = [_vector_inputs(spark, sf_dir, unit) for unit in (False, True)]
    tag = [F.lit(name).alias("config") for name in ("l2", "l2_unit")]
    queries = parts[0][0].select(tag[0], "*").unionByName(parts[1][0].select(tag[1], "*"))
    index = parts[0][1].select(tag[0], "*").unionByName(parts[1][1].select(tag[1], "*"))
    gold = parts[0][2].select(tag[0], "*").unionByName(parts[1][2].select(tag[1], "*"))
    hits = vectors.knn(queries, index, 100, exclude_self=True, group="config", keep=["doc_id"])
    return evaluate.accuracy_by_group(hits, gold, "config")


# ---------------------------------------------------------------- curation
@register("doc_ids")
def q_doc_ids(spark, sf_dir):
    raw = fixtures.passages_raw(spark, sf_dir)
    return curate.assign_doc_ids(raw, "title", prefix="d_").select("corpus_id", "doc_id")


@register("curated_titles")
def q_curated_titles(spark, sf_dir):
    return fixtures.passages(spark, sf_dir).select("corpus_id", "title", "text")


def _collapsed(p: DataFrame, n: int) -> DataFrame:
    c = curate.collapse_passages(p, n, series="src")
    return c.select("doc_id", F.array_join("corpus_id_array", ",").alias("corpus_ids"),
                    "title", "doc_text", "src", "first_num")


@register("collapse_2")
def q_collapse_2(spark, sf_dir):
    return _collapsed(fixtures.passages(spark, sf_dir), 2)


@register("collapse_3")
def q_collapse_3(spark, sf_dir):
    """Level 3 over de-duplicated passages: removed copies leave gaps in the ids."""
    p = curate.dedup_passages(fixtures.passages(spark, sf_dir), ["doc_id", "title", "text"], ["src", "num"])
    return _collapsed(p, 3)


@register("dedup_passages")
def q_dedup_passages(spark, sf_dir):
    c = curate.collapse_passages(fixtures.passages(spark, sf_dir), 2, series="src")
    d = curate.dedup_passages(c, ["doc_id", "title", "doc_text"], ["src", "first_num"])
    return d.select("doc_id", "title", "doc_text",
                    F.array_join("corpus_id_array", ",").alias("corpus_ids"))


# ---------------------------------------------------------------- coverage
def _corpora(spark, sf_dir):
    return (fixtures.corpus_passages(spark, sf_dir, english=True),
            fixtures.corpus_passages(spark, sf_dir, english=False))


@register("missing_titles_norm")
def q_missing_titles_norm(spark, sf_dir):
    nq, wiki = _corpora(spark, sf_dir)
    return coverage.missing_titles(nq, wiki)


@register("missing_titles_exact")
def q_missing_titles_exact(spark, sf_dir):
    """Titles of answer passages that do not occur in the noise corpus (NOT IN)."""
    nq, wiki = _corpora(spark, sf_dir)
    gold = coverage.gold_passages(fixtures.answers(spark, sf_dir), nq)
    return coverage.missing_exact(gold, wiki)


@register("title_coverage")
def q_title_coverage(spark, sf_dir):
    nq, wiki = _corpora(spark, sf_dir)
    return coverage.title_coverage(nq, wiki)


@register("query_trace")
def q_query_trace(spark, sf_dir):
    return coverage.query_trace(fixtures.queries(spark, sf_dir), fixtures.answers(spark, sf_dir),
                                fixtures.passages(spark, sf_dir))


@register("keyword_titles")
def q_keyword_titles(spark, sf_dir):
    _, wiki = _corpora(spark, sf_dir)
    return coverage.keyword_titles(wiki, ["La", "De"])


@register("match_questions")
def q_match_questions(spark, sf_dir):
    """Passage texts that occur in both corpora, with their multiplicities."""
    nq, wiki = _corpora(spark, sf_dir)
    return coverage.match_texts(nq.select("text"), wiki.select("text"), "text")


# ---------------------------------------------------------------- sampling
SEED = 42
# Fixed value: size of the easy noise set.
EASY_NOISE = 250000


@register("sample_rate")
def q_sample_rate(spark, sf_dir):
    return sample.sample_rate(fixtures.passages(spark, sf_dir), 0.2, "corpus_id", SEED).select(
        "corpus_id", "doc_id")


@register("sample_about")
def q_sample_about(spark, sf_dir):
    return sample.sample_about(fixtures.passages(spark, sf_dir), 1000, "corpus_id", SEED).select("corpus_id")


@register("sample_per_group")
def q_sample_per_group(spark, sf_dir):
    return sample.sample_per_group(fixtures.passages(spark, sf_dir), "doc_id", 5, "corpus_id", SEED).select(
        "doc_id", "corpus_id")


@register("batch_assign")
def q_batch_assign(spark, sf_dir):
    b = sample.build_batches(fixtures.passages(spark, sf_dir), 50, 20, "corpus_id", SEED)
    return b.select("corpus_id", "batch_id", "questions")


def _corpus_level(level):
    def run(spark, sf_dir):
        nq, wiki = _corpora(spark, sf_dir)
        return corpus.build_corpus(nq, wiki, fixtures.answers(spark, sf_dir), level, seed=SEED)
    return run


for _lvl in (1, 2, 3):
    register(f"corpus_level_{_lvl}")(_corpus_level(_lvl))


@register("gold_pairs")
def q_gold_pairs(spark, sf_dir):
    """Evaluation query set: distinct (query, gold document) of the level-3
    corpus, restricted to queries that have a text."""
    c = corpus.build_corpus(*_corpora(spark, sf_dir), fixtures.answers(spark, sf_dir), 3, seed=SEED)
    pairs = c.where(F.col("stage") == 1).select("query_id", "doc_id").distinct()
    q = fixtures.queries(spark, sf_dir)
    return pairs.join(q, "query_id").select("query_id", "doc_id", F.col("text").alias("query_text"))


# ---------------------------------------------------------------- text preparation
def _documents(spark, sf_dir):
    """Documents for work on whole texts, which is one map: dealt to all cores by id and text
    (rows may share an id), since one row group of a file is one task, however many bytes it has."""
    return read_table(spark, f"{sf_dir}/documents.parquet", ["doc_id", "text"], spread_by=["doc_id", "text"])


@register("sentence_split")
def q_sentence_split(spark, sf_dir):
    return textprep.split_sentences(_documents(spark, sf_dir))


@register("clean_sentences")
def q_clean_sentences(spark, sf_dir):
    return textprep.clean_sentences(_documents(spark, sf_dir))


@register("pack_segments")
def q_pack_segments(spark, sf_dir):
    return textprep.pack_segments(_documents(spark, sf_dir))


@register("prompts")
def q_prompts(spark, sf_dir):
    d = textprep.with_parts(_documents(spark, sf_dir), "doc_id", "text", seed=SEED)
    c = textprep.part_rows(d, "doc_id")
    return c.select("doc_id", textprep.candidate_text(F.col("cand_id")).alias("cand_id"), "style", "answer",
                    F.md5(textprep.prompt(F.col("answer"), F.col("context"))).alias("prompt_md5"))


@register("entities")
def q_entities(spark, sf_dir):
    s = textprep.clean_sentences(_documents(spark, sf_dir))
    return textprep.extract_entities(s).select("doc_id", "sent_id", "ent_id", "ent_text", "label")


@register("choices")
def q_choices(spark, sf_dir):
    d = textprep.with_entity_choices(_documents(spark, sf_dir), "doc_id", "text", "_e", seed=SEED)
    e = explode_rows(d, ["doc_id"], F.col("_e"), ["e"])
    return e.select("doc_id", "e.sent_id", "e.ent_id", "e.ent_text",
                    textprep.choices_text(F.col("e.choices")).alias("choices"))


@register("token_columns")
def q_token_columns(spark, sf_dir):
    """All tokens of every query text in windows of 20."""
    t = textprep.tokenize_fixed(fixtures.queries(spark, sf_dir), "query_id", "text", 20)
    return t.select("query_id", "window", F.array_join("ids", ",").alias("ids"), F.array_join("mask", ",").alias("mask"))


@register("passage_template")
def q_passage_template(spark, sf_dir):
    c = _corpus_level(3)(spark, sf_dir)
    return textprep.compose_passage(c, ["title", "text", "questions"]).select("stage", "corpus_ids", "passage")


# ---------------------------------------------------------------- models and augmentation
@register("hash_encode")
def q_hash_encode(spark, sf_dir):
    e = models.hash_encode_sparse(fixtures.passages(spark, sf_dir), "corpus_id", "text", 64)
    return e.select("corpus_id", "bucket", F.round("weight", 6).alias("weight"))


@register("encode_arrow")
def q_encode_arrow(spark, sf_dir):
    """Same encoder over Arrow batches (mapInPandas), non-zero entries listed."""
    e = models.encode(fixtures.passages(spark, sf_dir), "corpus_id", "text", dim=64,
                      encoder_factory=lambda: models.hashed_bow_encoder(64))
    nz = explode_rows(e, ["corpus_id"], F.col("embedding"), ["bucket", "weight"]).where(F.col("weight") != 0)
    return nz.select("corpus_id", "bucket", F.round("weight", 6).alias("weight"))


@register("score_pairs")
def q_score_pairs(spark, sf_dir):
    d = textprep.with_parts(_documents(spark, sf_dir), "doc_id", "text", seed=SEED)
    s = augment.score_pairs(augment.generate_questions(textprep.part_rows(d, "doc_id")))
    return s.select("doc_id", textprep.candidate_text(F.col("cand_id")).alias("cand_id"), "question", F.round("score", 6).alias("score"))


@register("rank_candidates")
def q_rank_candidates(spark, sf_dir):
    top = augment.scored_array(_documents(spark, sf_dir), "doc_id", "text", seed=SEED, n=10)
    r = explode_rows(top, ["doc_id"], F.col("_scored"), ["rank0", "s"])
    return r.select("doc_id", (F.col("rank0") + 1).alias("rank"),
                    textprep.candidate_text(F.col("s.cand_id")).alias("cand_id"), F.round("s.score", 6).alias("score"))


@register("augment")
def q_augment(spark, sf_dir):
    return augment.augment(_documents(spark, sf_dir), n=25, seed=SEED)


def _updated_corpus(spark, sf_dir):
    checkpoint_dir(spark)
    c = _corpus_level(3)(spark, sf_dir).checkpoint()  # target and source of the update
    keys = ["doc_id", "title", "text"]
    todo = (c.where(F.col("stage") == 1).select(*keys).distinct()
            .withColumn("_k", F.md5(F.concat_ws("\x1f", *keys))))
    updates = augment.augment(todo, key="_k", text="text", n=25, seed=SEED, keep=keys).select(*keys, "questions")
    return io.update_from(c, updates, keys, ["questions"])


@register("update_questions")
def q_update_questions(spark, sf_dir):
    return _updated_corpus(spark, sf_dir).select("stage", "query_id", "corpus_ids", "questions")


# ---------------------------------------------------------------- queue and indexes
@register("queue_pending")
def q_queue_pending(spark, sf_dir):
    """Queue = corpus rows without a query; half of it (hash) counts as processed."""
    checkpoint_dir(spark)
    # the queue is a stored table (read by both sides of the anti join)
    queue = _corpus_level(2)(spark, sf_dir).where(F.col("query_id").isNull()).checkpoint()
    done = sample.sample_rate(queue, 0.5, "corpus_ids", SEED)
    return io.remove_processed(queue, done, ["doc_id", "text"]).select("doc_id", "corpus_ids")


def _noise_indexes(spark, sf_dir):
    """Two gold indexes (with and without questions) and both with the noise stage appended.

    All three passage sets are encoded in one pass and stored; the noise vectors
    are appended to both indexes.
    """
    checkpoint_dir(spark)
    c = _updated_corpus(spark, sf_dir).checkpoint()
    gold, noise = c.where(F.col("stage") < 3), c.where(F.col("stage") == 3)
    # the row key: an answer group has one row per query it answers
    key = F.concat_ws("|", "corpus_ids", F.coalesce("query_id", F.lit("")))
    sets = [("qg", gold, ["title", "text", "questions"]), ("no_qg", gold, ["title", "text"]),
            ("noise", noise, ["title", "text"])]
    src = None
    for name, rows, parts in sets:
        one = textprep.compose_passage(rows, parts).select(F.lit(name).alias("set"), key.alias("key"), "doc_id", "passage")
        src = one if src is None else src.unionByName(one)
    encoded = models.encode(src, "key", "passage", keep=["set", "doc_id"]).checkpoint()
    qg, no_qg = (vectors.build_index(encoded.where(F.col("set") == name), "key") for name in ("qg", "no_qg"))
    return vectors.append_noise(encoded.where(F.col("set") == "noise"), [qg, no_qg])


@register("append_noise")
def q_append_noise(spark, sf_dir):
    """Encode the noise stage once, append it to two indexes; sizes and a digest of the vectors."""
    out = None
    for name, idx in zip(("qg", "no_qg"), _noise_indexes(spark, sf_dir)):
        n = vectors.index_stats(idx).withColumn("index_name", F.lit(name))
        weight = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
        digest = idx.select("origin", weight.alias("w"), "vec_id").rollup("origin").agg(
            F.round(F.sum("w"), 2).alias("vector_sum"), F.max("vec_id").alias("last_id")).select(
            F.coalesce("origin", F.lit("__all__")).alias("origin"), "vector_sum", "last_id")
        one = n.join(digest, "origin").select("index_name", "origin", "n", "vector_sum", "last_id")
        out = one if out is None else out.unionByName(one)
    return out


def _text_search(spark, sf_dir, k):
    """Hits of every benchmark text among all passages (hashed bag of words)."""
    checkpoint_dir(spark)
    p = fixtures.passages(spark, sf_dir).select("corpus_id", "src", "num", "text")
    encoded = models.encode(p, "corpus_id", "text", keep=["src", "num"])
    index = sample.row_index(encoded, ["src", "num"], "vec_id")  # encoded once, stored by the numbering
    b = read_table(spark, f"{sf_dir}/benchmark.parquet", ["item_id", "text"])
    q = models.encode(b, "item_id", "text").withColumnRenamed("item_id", "query_id").checkpoint()
    return vectors.knn(q, index, k, keep=["corpus_id", "src"])


@register("text_hits")
def q_text_hits(spark, sf_dir):
    """First 20 passages of every benchmark text, by id: equal vectors in passage order."""
    return _text_search(spark, sf_dir, 20).select("query_id", "rank", "corpus_id")


@register("text_retrieval")
def q_text_retrieval(spark, sf_dir):
    """Benchmark texts retrieve passages (exact 100-NN); a hit when a passage of
    any document that holds the text is among the first k."""
    gold = fixtures.answers(spark, sf_dir).select(F.col("item_id").alias("query_id"), "src")
    return evaluate.accuracy_at_k(_text_search(spark, sf_dir, 100), gold, doc="src")


@register("index_roundtrip")
def q_index_roundtrip(spark, sf_dir):
    """An index written, read back, extended by a second origin and searched; its
    id map exported as JSON lines and parsed back names the hits."""
    import os
    import uuid
    base = os.path.join(checkpoint_dir(spark), f"index-{uuid.uuid4().hex}")
    e = read_table(spark, f"{sf_dir}/embeddings.parquet", ["vec_id", "embedding", "label"]).select(
        F.col("vec_id").alias("key"), F.concat(F.lit("label"), F.col("label").cast("string")).alias("doc_id"), "embedding")
    io.write_index(vectors.build_index(e.where(F.col("key") % 2 == 0), "key"), f"{base}/index")
    stored = io.read_index(spark, f"{base}/index")
    extended, = vectors.append_noise(e, [stored])  # even keys are there already
    io.write_index(extended.where(F.col("origin") == "noise"), f"{base}/index", mode="append")
    whole = io.read_index(spark, f"{base}/index")
    io.export_id_map(whole, f"{base}/ids")
    queries = e.where(F.col("key") % 20 == 0).select(F.col("key").alias("query_id"), "embedding")
    hits = vectors.knn(queries, whole, 5)
    return hits.join(io.read_id_map(spark, f"{base}/ids"), "vec_id").select("query_id", "rank", "vec_id", "doc_id")


@register("corpus_table_build")
def q_corpus_table_build(spark, sf_dir):
    """The corpus table written in three statements (create as select, two inserts)
    and read back in its stored order of titles."""
    import os
    import uuid
    path = os.path.join(checkpoint_dir(spark), f"corpus-{uuid.uuid4().hex}")
    c = _corpus_level(2)(spark, sf_dir).drop("questions")
    io.save_table(c.where(F.col("stage") == 1), path)
    io.append_table(c.where(F.col("stage") == 2), path)
    io.append_table(c.where(F.col("stage") == 3), path)
    out = spark.read.parquet(path)
    return out.orderBy("title", "corpus_ids", "query_id").select("stage", "query_id", "title", "corpus_ids")


@register("passage_queries")
def q_passage_queries(spark, sf_dir):
    """Query texts merged into the corpus rows: left join on the query id (rows of
    the queue have none), projected and de-duplicated; passage ids as integers."""
    c = _corpus_level(2)(spark, sf_dir)
    q = fixtures.queries(spark, sf_dir).withColumnRenamed("text", "query_text")
    nums = F.transform(F.split("corpus_ids", ","), lambda x: F.substring_index(x, "_", -1).cast("int"))
    merged = c.join(q, "query_id", "left").select("query_text", "doc_id", "title", "text", nums.alias("nums")).distinct()
    return merged.select("query_text", "doc_id", "title", "text",
                         F.aggregate("nums", F.lit(0), lambda a, x: a + x).alias("num_sum"))


@register("plugged_augment")
def q_plugged_augment(spark, sf_dir):
    """Augmentation with generator and scorer plugged in as Arrow-batch models."""
    return augment.augment(_documents(spark, sf_dir), n=10, seed=SEED, generator_factory=models.cloze_generator,
                           scorer_factory=models.overlap_scorer)


@register("plugged_entities")
def q_plugged_entities(spark, sf_dir):
    """Entities by an extractor plugged in as an Arrow-batch model."""
    s = textprep.clean_sentences(_documents(spark, sf_dir))
    return textprep.extract_entities(s, extractor_factory=textprep.pattern_extractor).select(
        "doc_id", "sent_id", "ent_id", "ent_text", "label")


@register("stream_augment")
def q_stream_augment(spark, sf_dir):
    """Passages queued as arrival files, drained by an availableNow stream."""
    from passagekit.streaming.incremental import run_incremental
    p = fixtures.passages(spark, sf_dir).select("corpus_id", "text")
    out = run_incremental(spark, p, key="corpus_id", text="text", n=25, seed=SEED)
    return out.select("corpus_id", "questions", "n_questions")


@register("retrieval_grid")
def q_retrieval_grid(spark, sf_dir):
    """accuracy@k for 24 configurations (corpus x level x questions x title), one job."""
    from passagekit.plans.grid import retrieval_grid
    return retrieval_grid(spark, sf_dir, seed=SEED)


@register("ingest_corpus")
def q_ingest_corpus(spark, sf_dir):
    """Raw download -> table: the documents exported as JSON lines into the
    shared folder, read back with a declared schema, split into passages."""
    import os
    import uuid
    from pyspark.sql import types as T
    base = os.path.join(checkpoint_dir(spark), f"ingest-{uuid.uuid4().hex}")
    docs = fixtures.documents(spark, sf_dir, ["doc_id", "text", "lang"])
    docs.write.mode("overwrite").json(base)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType())])
    raw = io.ingest_corpus(spark, base, "json", schema)
    return raw.select("doc_id", "lang", F.size(F.split("text", "\n", -1)).alias("n_passages"))


def easy_noise(spark, sf_dir, n: int):
    """'Easy' noise set: the first ``n`` distinct level-3 groups of the noise corpus
    (the limit is the feature; ordered so that the choice is reproducible)."""
    _, wiki = _corpora(spark, sf_dir)
    g = curate.collapse_passages(wiki, 3, series="src").select(
        "doc_id", "title", F.col("doc_text").alias("text")).distinct()
    return sample.first_rows(g, ["doc_id", "title", "text"], n)


@register("easy_noise")
def q_easy_noise(spark, sf_dir):
    return easy_noise(spark, sf_dir, EASY_NOISE)


@register("easy_noise_500")
def q_easy_noise_500(spark, sf_dir):
    """The same with a limit that binds on small tables too."""
    return easy_noise(spark, sf_dir, 500)


@register("process_batches")
def q_process_batches(spark, sf_dir):
    """Sample 20 batches of about 50 passages, augment them in one job, append
    them to a target partitioned by batch_id; the target is returned."""
    import os
    import uuid
    from passagekit.plans.queue import process_batches
    target = os.path.join(checkpoint_dir(spark), f"batches-{uuid.uuid4().hex}")
    queue = fixtures.passages(spark, sf_dir).select("corpus_id", "text")
    process_batches(queue, target, "corpus_id", "text", n=25, batch_size=50, num_batches=20, seed=SEED)
    return spark.read.parquet(target).select("corpus_id", "batch_id", "questions")


@register("update_labels")
def q_update_labels(spark, sf_dir):
    """UPDATE documents SET quality, toxic FROM labels WHERE doc_id equal."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet", ["doc_id", "lang"]).select(
        "doc_id", "lang", F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))
    labels = read_table(spark, f"{sf_dir}/labels.parquet", ["doc_id", "quality", "toxic"])
    return io.update_from(docs, labels, ["doc_id"], ["quality", "toxic"])


@register("qa_pair_scores")
def q_qa_pair_scores(spark, sf_dir):
    """QA evaluator over real pairs: each user turn and the assistant turn after it."""
    qa = fixtures.qa_pairs(spark, sf_dir)
    return qa.select("conv_id", "turn", F.round(models.default_score(F.col("question"), F.col("answer")), 6)
                     .alias("score"))


# ---------------------------------------------------------------- stored state
def _folder(spark: SparkSession, name: str) -> str:
    import uuid
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("stored_changes")
def q_stored_changes(spark, sf_dir):
    """A stored table updated from the labels and then rid of the toxic documents; read back."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet", ["doc_id", "source", "lang", "n_chars"])
    labels = read_table(spark, f"{sf_dir}/labels.parquet", ["doc_id", "quality", "toxic"])
    table = BucketTable.create(docs, _folder(spark, "table"), ["doc_id"], buckets=16)
    table.update(labels.select("doc_id", F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("source")),
                 ["source"])
    table.delete(labels.where("toxic = 1"))
    return table.read()


@register("claimed_segments")
def q_claimed_segments(spark, sf_dir):
    """Documents cut into segments by two sessions that share the queue: one takes a
    third of the ranges, the other what is left."""
    queue = read_table(spark, f"{sf_dir}/documents.parquet", ["doc_id", "text"])
    folder = _folder(spark, "claims")
    claims.process_claims(queue, folder, "doc_id", textprep.pack_segments, ranges=12, take=4, session="a", rounds=1)
    claims.process_claims(queue, folder, "doc_id", textprep.pack_segments, ranges=12, take=12, session="b")
    return claims.results(spark, folder)


@register("title_dictionary")
def q_title_dictionary(spark, sf_dir):
    """Two loads of titles: the English documents', then all documents'."""
    path = _folder(spark, "titles")
    docs = read_table(spark, f"{sf_dir}/documents.parquet", ["text", "lang"]).withColumn(
        "title", F.substring_index("text", "\n", 1))
    extend_dictionary(docs.where("lang = 'en'"), path)
    return extend_dictionary(docs, path)


@register("keyword_table")
def q_keyword_table(spark, sf_dir):
    """Titles of the documents that hold the words of the benchmark, their first two letters, or nothing."""
    titles = read_table(spark, f"{sf_dir}/documents.parquet", ["text"]).select(
        F.substring_index("text", "\n", 1).alias("title"))
    items = read_table(spark, f"{sf_dir}/benchmark.parquet", ["text"])
    words = explode_rows(items, [], F.split("text", " ", -1), ["word"])
    table = words.select(F.explode(F.array("word", F.substring("word", 1, 2), F.lit(""), F.lit(None).cast("string")))
                         .alias("keyword"))
    found = keywords.keyword_matches(titles, table)
    return found.groupBy("keyword").agg(F.count(F.lit(1)).alias("n_titles"), F.min("title").alias("first_title"))


@register("ingest_rejects")
def q_ingest_rejects(spark, sf_dir):
    """A raw export in which every seventh record is cut short: table and rejects."""
    from pyspark.sql import types as T
    base = _folder(spark, "raw")
    docs = read_table(spark, f"{sf_dir}/documents.parquet", ["doc_id", "lang", "source", "n_chars"])
    line = F.to_json(F.struct("doc_id", "lang", "source", "n_chars"))
    docs.select("doc_id", line.alias("line")).selectExpr(
        "CASE WHEN doc_id % 7 = 0 THEN substring(line, 1, length(line) - 2) ELSE line END AS value").write.text(base)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()),
                           T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
    table, rejects = io.ingest_with_rejects(spark, base, "json", schema)
    return table.withColumn("record", F.lit(None).cast("string")).unionByName(
        rejects.select("record"), allowMissingColumns=True)


@register("encode_budgeted")
def q_encode_budgeted(spark, sf_dir):
    """The encoder over batches of similar length, each of at most 4096 padded words."""
    e = models.encode(fixtures.passages(spark, sf_dir), "corpus_id", "text", dim=64, budget=4096,
                      encoder_factory=lambda: models.hashed_bow_encoder(64))
    nz = explode_rows(e, ["corpus_id"], F.col("embedding"), ["bucket", "weight"]).where(F.col("weight") != 0)
    return nz.select("corpus_id", "bucket", F.round("weight", 6).alias("weight"))


@register("extended_search")
def q_extended_search(spark, sf_dir):
    """10-NN of every embedding in an index built in two loads: the hits of the first
    load are stored, the second load is searched alone and merged in."""
    queries, index, _ = _vector_inputs(spark, sf_dir)
    first, second = index.where(F.col("vec_id") % 3 != 0), index.where(F.col("vec_id") % 3 == 0)
    path = _folder(spark, "hits")
    vectors.knn(queries, first, 10, exclude_self=True).write.parquet(path)
    found = hit_tables.search_appended(spark.read.parquet(path), queries, second, 10, exclude_self=True)
    return found.select("query_id", "rank", "vec_id", F.round("d2", 6).alias("d2"))
