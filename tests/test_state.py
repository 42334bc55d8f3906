"""Stored tables, shared queues, dictionaries, rejected records, keyword tables, batches and kept hits."""

import random
import threading
import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagekit.operators import hits, keywords, models, vectors
from passagekit.operators.dictionary import extend_dictionary, read_dictionary
from passagekit.plans import claims
from passagekit.sources import buckets, io
from passagekit.sources.buckets import BucketTable


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---------------------------------------------------------------- stored tables
def made(spark, tmp_path, n=60):
    data = [(k, f"v{k}", None) for k in range(n)] + [(None, "no key", None)]
    df = spark.createDataFrame(data, "id long, value string, extra int")
    return BucketTable.create(df, str(tmp_path / "t"), ["id"], buckets=16), data


def files(table):
    import os
    return {b: sorted(x for f in fs for x in os.listdir(f.removeprefix("file:")) if x.endswith(".parquet"))
            for b, fs in table.files().items()}


def test_update_and_delete_touch_their_buckets_only(spark, tmp_path):
    table, data = made(spark, tmp_path)
    before = files(table)
    table.update(spark.createDataFrame([(3, 7), (999, 1)], "id long, extra int"), ["extra"])
    assert rows(table.read()) == sorted([(k, v, 7 if k == 3 else e) for k, v, e in data], key=repr)
    after = files(table)
    assert sum(before[b] != after.get(b) for b in before) <= 2 and sum(before[b] == after.get(b) for b in before) >= 12
    table.delete(spark.createDataFrame([(5,), (None,)], "id int"))
    # a NULL key never equals anything, as in SQL
    assert rows(table.read()) == sorted([(k, v, 7 if k == 3 else e) for k, v, e in data if k != 5], key=repr)


def test_append_and_replace(spark, tmp_path):
    table, data = made(spark, tmp_path, 5)
    table.append(spark.createDataFrame([("x", 100, 1)], "value string, id int, extra int"))
    assert rows(table.read()) == sorted([*data, (100, "x", 1)], key=repr)
    BucketTable.create(spark.createDataFrame([(1, "only")], "id long, value string"), table.path, ["id"], 4)
    assert rows(table.read()) == [(1, "only")]


def test_everything_deleted(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, value string")
    table = BucketTable.create(df, str(tmp_path / "t"), ["id"], 4)
    table.delete(df.select("id"))
    assert rows(table.read()) == [] and table.read().columns == ["id", "value"]
    table.append(df)
    assert rows(table.read()) == [(1, "a"), (2, "b")]


def test_ambiguous_update_fails_and_changes_nothing(spark, tmp_path):
    table, data = made(spark, tmp_path, 5)
    with pytest.raises(Exception, match="more than once"):
        table.update(spark.createDataFrame([(3, 7), (3, 8)], "id long, extra int"), ["extra"])
    assert rows(table.read()) == sorted(data, key=repr)


def test_failure_before_the_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table, data = made(spark, tmp_path)
    kept = files(table)

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(buckets, "commit", lost)
        with pytest.raises(OSError):
            table.delete(table.read().select("id"))
    assert rows(table.read()) == sorted(data, key=repr) and files(table) == kept
    table.delete(spark.createDataFrame([(1,)], "id long"))
    assert table.read().count() == len(data) - 1


# ---------------------------------------------------------------- shared queues
def queue_of(spark, n=200):
    return spark.range(n).select(F.col("id").alias("key"), (F.col("id") * 2).alias("x"))


def doubled(df):
    return df.select("key", (F.col("x") * 2).alias("y"))


def test_two_sessions_at_once_give_each_key_once(spark, tmp_path):
    queue, folder, done = queue_of(spark), str(tmp_path / "q"), {}

    def work(name):
        done[name] = claims.process_claims(queue, folder, "key", doubled, ranges=12, take=2, session=name)

    threads = [threading.Thread(target=work, args=(n,)) for n in ("a", "b")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert claims.finished(spark, folder, 12) and sum(done.values()) >= 12
    assert rows(claims.results(spark, folder)) == sorted(((k, 4 * k) for k in range(200)), key=repr)


def test_a_dead_sessions_lease_runs_out(spark, tmp_path):
    queue, folder = queue_of(spark), str(tmp_path / "q")

    def dies(df):
        raise OSError("lost")

    with pytest.raises(OSError):
        claims.process_claims(queue, folder, "key", dies, ranges=6, take=6, lease=3.0, session="dead")
    assert claims.process_claims(queue, folder, "key", doubled, ranges=6, take=6, session="early") == 0
    time.sleep(3.2)
    assert claims.process_claims(queue, folder, "key", doubled, ranges=6, take=6, session="late") == 6
    assert claims.results(spark, folder).count() == 200


def test_a_second_result_of_a_range_does_not_count(spark, tmp_path):
    queue, folder = queue_of(spark, 50), str(tmp_path / "q")
    claims.process_claims(queue, folder, "key", doubled, ranges=3, take=3, session="a")
    late = f"{folder}/results/late"
    doubled(queue).withColumn(claims.RANGE, claims.range_of("key", 3)).write.parquet(late)
    now = time.time()
    claims.commit(spark, folder, [(r, "b", "done", now, now, late) for r in range(3)], claims.LOG)
    assert rows(claims.results(spark, folder)) == sorted(((k, 4 * k) for k in range(50)), key=repr)


# ---------------------------------------------------------------- dictionary
def test_ids_stay_when_titles_are_added(spark, tmp_path, monkeypatch):
    from passagekit.operators import dictionary

    path = str(tmp_path / "d")
    load = lambda *t: spark.createDataFrame([(x,) for x in t], "title string")
    first = rows(extend_dictionary(load("m", "b", "b", "z"), path))
    assert first == [("b", 1, 1), ("m", 2, 1), ("z", 3, 1)]

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(dictionary, "commit", lost)
        with pytest.raises(OSError):
            extend_dictionary(load("lost"), path)
    second = rows(extend_dictionary(load("a", None, "m", "é", None), path))
    assert second == sorted([*first, (None, 4, 2), ("a", 5, 2), ("é", 6, 2)], key=repr)
    assert rows(extend_dictionary(load("a", None), path)) == second == rows(read_dictionary(spark, path))


# ---------------------------------------------------------------- rejected records
SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType())])


@pytest.mark.parametrize("fmt,good,bad", [
    ("json", ['{"id":1,"title":"a"}', '{"id":2}'], ['{"id":3,"title":"b', "no json", '{"id":"x","title":"c"}']),
    ("csv", ["1,a", '2,"b, c"'], ["x,d", "3", "4,e,f"]),
    ("tsv", ["1\ta", "2\tb c"], ["x\td", "3", "4\te\tf"])])
def test_broken_records_are_set_aside(spark, tmp_path, fmt, good, bad):
    lines = [x for pair in zip(good, bad) for x in pair] + bad[2:]
    head = {"csv": ["id,title"], "tsv": ["id\ttitle"]}.get(fmt, [])
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "one.txt").write_text("\n".join(head + lines) + "\n")
    options = {"header": "true"} if fmt == "csv" else {}
    table, rejects = io.ingest_with_rejects(spark, str(tmp_path / "raw"), fmt, SCHEMA, **options)
    assert table.count() == len(good) and {r.id for r in table.collect()} == {1, 2}
    assert rows(rejects) == sorted((("one.txt", b) for b in bad), key=repr)
    assert table.columns == ["id", "title"]


# ---------------------------------------------------------------- keyword tables
def test_keyword_table_against_like(spark):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("ab_%é ") for _ in range(n))
    titles = [make(rng.randint(0, 12)) for _ in range(80)] + [None, "", "aa", "aa"]
    words = [make(rng.randint(1, 5)) for _ in range(60)] + ["", "", None, "a", "é%"]
    got = keywords.keyword_matches(spark.createDataFrame([(t,) for t in titles], "title string"),
                                   spark.createDataFrame([(w,) for w in words], "keyword string"))
    want = {(w, t) for w in words if w is not None for t in titles if t is not None and w in t}
    assert rows(got) == sorted(want, key=repr)


def test_keyword_runs_are_broadcast(spark, monkeypatch):
    """Runs of titles are joined where they are cut; very many words are joined by a shuffle, with the same pairs."""
    titles = spark.createDataFrame([("The Old House",), ("On the hill",), ("",)], "title string")
    words = spark.createDataFrame([("The",), ("hill",), ("th",), ("O",), ("",), ("zzz",)], "keyword string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    small = keywords.keyword_matches(titles, words)
    assert plan(small).count("strategy=broadcast") == 3
    monkeypatch.setattr(keywords, "BROADCAST_RUNS", 0)
    large = keywords.keyword_matches(titles, words)
    assert "strategy=broadcast" not in plan(large) and rows(small) == rows(large) and len(rows(small)) == 8


# ---------------------------------------------------------------- batches sized for the model
@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=80), st.integers(1, 200))
def test_budget_batches(lengths, budget):
    lengths = np.array(lengths, np.int64)
    batches = models.budget_batches(lengths, budget)
    assert sorted(k for b in batches for k in b.tolist()) == list(range(len(lengths)))
    assert all(len(b) == 1 or len(b) * lengths[b].max() <= budget for b in batches)


def test_batches_of_similar_length_pad_less():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 400, 2000)
    plain = [np.arange(a, min(a + 16, 2000)) for a in range(0, 2000, 16)]
    assert models.padding_share(plain, lengths) > 0.3
    assert models.padding_share(models.budget_batches(lengths, 3200), lengths) < 0.05


def test_budgeted_model_sees_bounded_batches(spark):
    rng = random.Random(5)
    data = [(k, "w " * rng.choice([0, 1, 5, 40, 300])) for k in range(500)] + [(900, None), (901, "x " * 5000)]
    df = spark.createDataFrame(data, "id long, text string").repartition(3)

    def factory():
        def run(b: pd.DataFrame) -> pd.DataFrame:
            size = b["text"].fillna("").str.split(" ").str.len()
            return pd.DataFrame({"id": b["id"], "places": [int(size.max()) * len(b)] * len(b), "rows": [len(b)] * len(b)})
        return run

    out = models.apply_budgeted(df, factory, "id long, places long, rows long",
                                F.size(F.split(F.coalesce("text", F.lit("")), " ", -1)), 1000).collect()
    assert sorted(r.id for r in out) == sorted(k for k, _ in data)
    assert all(r.places <= 1000 or r.rows == 1 for r in out) and max(r.rows for r in out) > 20


def test_budgeted_encoder_equals_the_plain_one(spark):
    df = spark.createDataFrame([(k, "a b " * (k % 9) + "c") for k in range(60)] + [(99, None), (98, "")], "id long, text string")
    plain = {r.id: list(r.embedding) for r in models.encode(df, "id", "text", dim=8).collect()}
    assert {r.id: list(r.embedding) for r in models.encode(df, "id", "text", dim=8, budget=32).collect()} == plain


def test_a_buffer_of_budgeted_batches_is_one_arrow_batch(spark, monkeypatch):
    """The model sees batches within the budget, Arrow sees one batch per buffer."""
    class Frame:
        sparkSession = spark
        withColumn = lambda self, *_: self
        mapInPandas = lambda self, run, schema: run

    seen = []

    def factory():
        return lambda b: seen.append(len(b)) or b

    run = models.apply_budgeted(Frame(), factory, "", F.lit(1), 10)
    out = list(run([pd.DataFrame({"id": range(400), "_length": 2})]))
    assert len(seen) == 80 and max(seen) == 5
    assert [len(b) for b in out] == [320, 80] and sorted(pd.concat(out)["id"]) == list(range(400))


def test_encoder_equals_counting_words(monkeypatch):
    import hashlib
    monkeypatch.setattr(models, "CACHED_TOKENS", 3)
    texts = ["A b  a c", None, "", "d e f g a A", "\u0130x b"]
    want = np.zeros((5, 6))
    for row, text in enumerate(texts):
        for t in (text or "").lower().split(" "):
            if t:
                want[row, int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 6] += 1
    norm = np.sqrt((want * want).sum(axis=1, keepdims=True))
    want = np.divide(want, norm, out=np.zeros_like(want), where=norm > 0)
    encode = models.hashed_bow_encoder(6)
    assert (encode(pd.Series(texts)) == want).all() and encode(pd.Series([], dtype=object)).shape == (0, 6)


# ---------------------------------------------------------------- kept hits
def test_extended_search_equals_the_full_search(spark):
    rng = np.random.default_rng(2)
    vecs = [(k, rng.integers(0, 4, 3).astype(float).tolist()) for k in range(150)]  # many ties
    index = spark.createDataFrame([(k, str(k), v) for k, v in vecs], "key long, doc_id string, embedding array<double>")
    old = vectors.build_index(index.where("key < 90"), "key")
    whole, = vectors.append_noise(index, [old])
    whole = whole.checkpoint()
    q = spark.createDataFrame(vecs[:40], "query_id long, embedding array<double>")
    stored = vectors.knn(q, whole.where("origin = 'gold'"), 6).checkpoint()
    got = hits.search_appended(stored, q, whole.where("origin = 'noise'"), 6)
    assert rows(got) == rows(vectors.knn(q, whole, 6))
    assert rows(hits.merge_hits([stored, stored], 6)) == rows(stored)


def test_grid_lets_go_of_finished_steps(spark):
    """A step stored by the grid stays while it is used; its files go once a later step is stored."""
    import glob
    import time

    from passagekit.plans import grid
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(glob.glob(f"{folder}/rdd-*"))
    first = grid._settled(spark.range(50))
    used = set(glob.glob(f"{folder}/rdd-*")) - before
    assert used and first.count() == 50
    second = grid._settled(first.where("id > 9"))
    assert all(map(glob.glob, used)) and first.count() == 50
    del first
    for _ in range(40):
        second = grid._settled(second)
        if not any(map(glob.glob, used)):
            break
        time.sleep(0.5)
    assert not any(map(glob.glob, used)) and second.count() == 40
