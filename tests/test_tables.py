"""Sampling, batches, NOT IN, update-from-join, queue, streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagekit.operators import augment, coverage, sample
from passagekit.sources import io


def test_sample_subset_and_partition_independent(spark):
    df = spark.range(2000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    small = {r["key"] for r in sample.sample_rate(df, 0.1, "key", seed=5).collect()}
    big = {r["key"] for r in sample.sample_rate(df.repartition(7), 0.3, "key", seed=5).collect()}
    assert small <= big and 100 < len(small) < 300
    again = {r["key"] for r in sample.sample_rate(df.repartition(3), 0.1, "key", seed=5).collect()}
    assert again == small


@pytest.mark.parametrize("rows,batches", [(8, 3), (2, 5), (100, 7), (21, 21)])
def test_batches_like_array_split(spark, rows, batches):
    df = spark.range(rows).withColumnRenamed("id", "k")
    out = sample.assign_batches(df, batches, [F.col("k")]).collect()
    sizes = np.bincount([r["batch_id"] for r in out], minlength=batches + 1)[1:]
    expect = [len(a) for a in np.array_split(np.arange(rows), batches)]
    assert list(sizes) == [e for e in expect if e] + [0] * (len(sizes) - len([e for e in expect if e]))
    order = sorted(out, key=lambda r: r["k"])
    assert [r["batch_id"] for r in order] == sorted(r["batch_id"] for r in order)


def test_sample_per_group_limit(spark):
    df = spark.createDataFrame([("hot", f"k{i}") for i in range(500)] + [("cold", "c1")], "g string, key string")
    out = sample.sample_per_group(df, "g", 5, "key", seed=1).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in out} == {"hot": 5, "cold": 1}


def test_not_in_null_semantics(spark):
    a = spark.createDataFrame([("x",), ("y",), (None,)], "title string")
    b_null = spark.createDataFrame([("x",), (None,)], "title string")
    b_plain = spark.createDataFrame([("x",)], "title string")
    b_empty = spark.createDataFrame([], "title string")
    assert coverage.missing_exact(a, b_null).count() == 0
    assert [r["title"] for r in coverage.missing_exact(a, b_plain).collect()] == ["y"]
    assert sorted(r["title"] for r in coverage.missing_exact(a, b_empty).collect()) == ["x", "y"]


def test_missing_titles_normalised(spark):
    a = spark.createDataFrame([("New York",), ("Paris",), (None,)], "title string")
    b = spark.createDataFrame([("newyork",)], "title string")
    assert sorted(str(r["title"]) for r in coverage.missing_titles(a, b).collect()) == ["None", "Paris"]


def test_update_from_cases(spark):
    target = spark.createDataFrame([("d1", "t", None), ("d2", "t", "old"), (None, "t", "keep")],
                                   "doc_id string, text string, questions string")
    upd = spark.createDataFrame([("d1", "t", "new"), ("d9", "t", "x"), (None, "t", "nullkey")],
                                "doc_id string, text string, questions string")
    got = {r["doc_id"]: r["questions"] for r in io.update_from(target, upd, ["doc_id", "text"], ["questions"]).collect()}
    assert got == {"d1": "new", "d2": "old", None: "keep"}
    dup = spark.createDataFrame([("d1", "t", "a"), ("d1", "t", "b")], "doc_id string, text string, questions string")
    with pytest.raises(Exception, match="more than once"):
        io.update_from(target, dup, ["doc_id", "text"], ["questions"]).collect()
    # duplicates that match no target row are not an error
    dup_other = spark.createDataFrame([("d7", "t", "a"), ("d7", "t", "b")], "doc_id string, text string, questions string")
    assert io.update_from(target, dup_other, ["doc_id", "text"], ["questions"]).count() == 3


def test_remove_processed_pairwise(spark):
    pending = spark.createDataFrame([("d1", "a"), ("d1", "b"), ("d2", "a")], "doc_id string, text string")
    done = spark.createDataFrame([("d1", "a"), ("d2", "b")], "doc_id string, text string")
    left = sorted(tuple(r) for r in io.remove_processed(pending, done, ["doc_id", "text"]).collect())
    assert left == [("d1", "b"), ("d2", "a")]


def test_augment_ranked_and_unranked(spark):
    df = spark.createDataFrame([(1, "Alice met Bob in Paris. They talked for 20 minutes. It was fine."),
                                (2, "")], "doc_id long, text string")
    ranked = {r["doc_id"]: r for r in augment.augment(df, n=2, seed=1).collect()}
    assert ranked[1]["n_questions"] == 2 and ranked[2]["questions"] == ""
    assert ranked[1]["questions"].count(" [SEP] ") == 2
    full = {r["doc_id"]: r for r in augment.augment(df, evaluate=False, seed=1).collect()}
    assert full[1]["n_questions"] > 2


def test_stream_twice_is_idempotent(spark):
    from passagekit.streaming.incremental import queue_from, stream_augment
    import tempfile, os
    base = tempfile.mkdtemp(prefix="pk-stream-")
    df = spark.createDataFrame([(i, f"Sentence {i} is here. Another one {i}.") for i in range(20)],
                               "doc_id long, text string")
    in_dir = queue_from(df, base)
    schema = spark.read.parquet(in_dir).schema
    out1 = stream_augment(spark, in_dir, os.path.join(base, "t"), os.path.join(base, "c"), schema, n=3).count()
    out2 = stream_augment(spark, in_dir, os.path.join(base, "t"), os.path.join(base, "c"), schema, n=3).count()
    assert out1 == out2 == 20


def test_stream_picks_up_new_arrivals_only(spark):
    from passagekit.streaming.incremental import queue_from, stream_augment
    import tempfile, os
    base = tempfile.mkdtemp(prefix="pk-stream2-")
    first = spark.createDataFrame([(i, f"Alpha {i} went home. Beta {i} stayed.") for i in range(10)],
                                  "doc_id long, text string")
    in_dir = queue_from(first, base)
    schema = spark.read.parquet(in_dir).schema
    t, c = os.path.join(base, "t"), os.path.join(base, "c")
    assert stream_augment(spark, in_dir, t, c, schema, n=2).count() == 10
    more = spark.createDataFrame([(i, f"Gamma {i} ran. Delta {i} sat.") for i in range(10, 15)],
                                 "doc_id long, text string").withColumn("_arrival", F.lit(9))
    more.write.mode("append").partitionBy("_arrival").parquet(in_dir)
    out = stream_augment(spark, in_dir, t, c, schema, n=2)
    assert out.count() == 15 and out.select("doc_id").distinct().count() == 15


def test_results_independent_of_partition_count(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    qs = E.queries()
    results = {}
    for parts in (3, 11):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        results[parts] = {name: sorted(tuple(r) for r in qs[name](spark, sf).collect())
                          for name in ("doc_ids", "collapse_3", "batch_assign", "sample_per_group")}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[3] == results[11]


def test_process_batches_partitions_the_queue(spark):
    import os
    import tempfile
    from passagekit.plans.queue import process_batches
    target = os.path.join(tempfile.mkdtemp(prefix="pk-batches-"), "t")
    queue = spark.createDataFrame([(f"k{i}", f"Item {i} is here. It is fine.") for i in range(200)],
                                  "corpus_id string, text string")
    rest = process_batches(queue, target, "corpus_id", n=2, batch_size=10, num_batches=5, seed=3)
    done = spark.read.parquet(target)
    done_keys = {r["corpus_id"] for r in done.collect()}
    rest_keys = {r["corpus_id"] for r in rest.collect()}
    assert done_keys and not (done_keys & rest_keys)
    assert done_keys | rest_keys == {f"k{i}" for i in range(200)}
    assert sorted({r["batch_id"] for r in done.collect()}) == [1, 2, 3, 4, 5]
    assert all(r["questions"] for r in done.collect())


def test_stream_two_files_equals_one(spark):
    from passagekit.streaming.incremental import queue_from, stream_augment
    import tempfile, os
    df = spark.createDataFrame([(i, f"Zeta {i} came. Omega {i} left.") for i in range(12)],
                               "doc_id long, text string")
    outs = []
    for parts in (1, 2):
        base = tempfile.mkdtemp(prefix=f"pk-stream-{parts}-")
        in_dir = queue_from(df, base, parts=parts)
        schema = spark.read.parquet(in_dir).schema
        out = stream_augment(spark, in_dir, os.path.join(base, "t"), os.path.join(base, "c"), schema, n=2)
        outs.append(sorted((r["doc_id"], r["questions"]) for r in out.collect()))
    assert outs[0] == outs[1] and len(outs[0]) == 12


def test_pluggable_path_equals_inrow_default(spark):
    # defined inside the test so that cloudpickle ships it by value to the workers
    def _py_jaccard_factory():
        import pandas as pd

        def words(s):
            return {w for w in (s or "").lower().split(" ") if w}

        def score(questions, answers):
            out = []
            for q, a in zip(questions, answers):
                qs, as_ = words(q), words(a)
                u = len(qs | as_)
                out.append(0.0 if u == 0 else len(qs & as_) / u)
            return pd.Series(out, dtype="float64")
        return score

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    inrow = augment.augment(docs, n=5, seed=3)
    plugged = augment.augment(docs, n=5, seed=3, scorer_factory=_py_jaccard_factory)
    a = sorted(tuple(r) for r in inrow.collect())
    b = sorted(tuple(r) for r in plugged.collect())
    assert len(a) == 200 and a == b


def test_pluggable_generator_equals_inrow_default(spark):
    def generator_factory():
        def gen(b):
            out = []
            for a, c, style in zip(b["answer"], b["context"], b["style"]):
                if style == "multiple_choice":
                    out.append(c.replace(a, "____") + "?")
                else:
                    longest = ""
                    for w in a.split(" "):
                        if len(w) > len(longest):
                            longest = w
                    out.append((a if longest == "" else a.replace(longest, "____")) + "?")
            return out
        return gen

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    a = sorted(tuple(r) for r in augment.augment(docs, n=5, seed=3).collect())
    b = sorted(tuple(r) for r in augment.augment(docs, n=5, seed=3, generator_factory=generator_factory).collect())
    assert len(a) == 200 and a == b


def test_process_batches_twice_gives_each_key_once(spark):
    import os
    import tempfile
    from passagekit.plans.queue import process_batches
    target = os.path.join(tempfile.mkdtemp(prefix="pk-batches-"), "t")
    queue = spark.createDataFrame([(f"k{i}", f"Item {i} is here. It is fine.") for i in range(60)],
                                  "corpus_id string, text string")
    for seed in (3, 3, 4):
        rest = process_batches(queue, target, "corpus_id", n=2, batch_size=10, num_batches=2, seed=seed)
    done = [r["corpus_id"] for r in spark.read.parquet(target).collect()]
    assert len(done) == len(set(done)) and not set(done) & {r["corpus_id"] for r in rest.collect()}
    assert len(done) + rest.count() == 60


def test_stream_duplicate_keys_and_unreadable_target(spark):
    from passagekit.streaming.incremental import queue_from, stream_augment
    import os
    import tempfile
    base = tempfile.mkdtemp(prefix="pk-stream3-")
    df = spark.createDataFrame([(i % 5, f"Alpha {i % 5} went home. Beta stayed.") for i in range(15)],
                               "doc_id long, text string")
    in_dir = queue_from(df, base)
    schema = spark.read.parquet(in_dir).schema
    out = stream_augment(spark, in_dir, os.path.join(base, "t"), os.path.join(base, "c"), schema, n=2)
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(5))
    broken = os.path.join(base, "broken")
    os.makedirs(broken)
    with open(os.path.join(broken, "part-0.parquet"), "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception, match="parquet"):
        io.table_exists(spark, broken) and spark.read.parquet(broken).count()
    assert not io.table_exists(spark, os.path.join(base, "nowhere"))


def test_augment_keeps_columns(spark):
    df = spark.createDataFrame([(1, "Alice met Bob. They talked.", "x"), (2, "", "y")], "doc_id long, text string, tag string")
    got = {r["doc_id"]: (r["tag"], r["text"]) for r in augment.augment(df, n=2, keep=["tag", "text"]).collect()}
    assert got == {1: ("x", "Alice met Bob. They talked."), 2: ("y", "")}


def test_ingest_formats(spark, tmp_path):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
    df = spark.createDataFrame([(1, "a b"), (2, "c,d")], schema)
    df.write.option("header", "true").csv(f"{tmp_path}/csv")
    df.write.option("header", "true").option("sep", "\t").csv(f"{tmp_path}/tsv")
    df.write.json(f"{tmp_path}/json")
    for fmt, options in (("csv", {"header": "true"}), ("tsv", {}), ("json", {})):
        got = io.ingest_corpus(spark, f"{tmp_path}/{fmt}", fmt, schema, **options)
        assert sorted(map(tuple, got.collect())) == [(1, "a b"), (2, "c,d")], fmt


def test_first_rows_is_the_ordered_limit(spark):
    df = spark.createDataFrame([(f"t{i * 37 % 101:03d}",) for i in range(101)], "t string").repartition(6)
    assert sorted(r["t"] for r in sample.first_rows(df, ["t"], 30).collect()) == [f"t{i:03d}" for i in range(30)]
    assert sample.first_rows(df, ["t"], 0).count() == 0
