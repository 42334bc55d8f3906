"""Exact k-NN and evaluation against numpy brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagekit.operators import evaluate, vectors


def _frame(spark, ids, mat, key):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, mat)],
                                 f"{key} long, embedding array<float>")


def brute(q_ids, Q, x_ids, X, k, exclude_self):
    out = []
    for qi, qv in zip(q_ids, Q.astype(np.float64)):
        d = ((X.astype(np.float64) - qv) ** 2).sum(axis=1)
        cand = [(d[j], x_ids[j]) for j in range(len(x_ids)) if not (exclude_self and x_ids[j] == qi)]
        cand.sort()
        for r, (dd, xi) in enumerate(cand[:k], start=1):
            out.append((qi, r, xi))
    return sorted(out)


@pytest.mark.parametrize("qrows,xrows", [(1000, 1000), (7, 13), (3, 5)])
def test_knn_matches_brute_force_any_grid(spark, qrows, xrows):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(60, 8)).astype(np.float32)
    X[10] = X[11]                      # identical vectors -> tie broken by id
    X[20] = X[21] = X[22]
    ids = np.arange(100, 160)
    df = _frame(spark, ids, X, "vec_id")
    q = df.withColumnRenamed("vec_id", "query_id")
    got = vectors.knn(q, df, 5, exclude_self=True, q_block_rows=qrows, x_block_rows=xrows)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id").collect()) == \
        brute(ids, X, ids, X, 5, True)


def test_knn_k_larger_than_index(spark):
    X = np.eye(4, dtype=np.float32)
    df = _frame(spark, range(4), X, "vec_id")
    q = _frame(spark, [9], np.array([[1, 0, 0, 0]], dtype=np.float32), "query_id")
    got = vectors.knn(q, df, 10).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 3]
    assert got[0]["d2"] == 0.0 and got[1]["d2"] == 2.0


def test_accuracy_monotone_and_prefix(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(80, 6)).astype(np.float32)
    df = _frame(spark, range(80), X, "vec_id").withColumn("doc_id", (F.col("vec_id") % 7).cast("string"))
    q = df.select(F.col("vec_id").alias("query_id"), "embedding")
    gold = df.select(F.col("vec_id").alias("query_id"), "doc_id")
    hits20 = vectors.resolve_neighbors(vectors.knn(q, df, 20, exclude_self=True), df)
    acc = {r["k"]: r["accuracy"] for r in evaluate.accuracy_at_k(hits20, gold, ks=(1, 5, 10, 20)).collect()}
    assert acc[1] <= acc[5] <= acc[10] <= acc[20]
    h10 = vectors.knn(q, df, 10, exclude_self=True).select("query_id", "rank", "vec_id")
    h20 = vectors.knn(q, df, 20, exclude_self=True).where("rank <= 10").select("query_id", "rank", "vec_id")
    assert sorted(h10.collect()) == sorted(h20.collect())


def test_gold_missing_counts_as_miss_and_check_gold_raises(spark):
    hits = spark.createDataFrame([("q1", 1, "a"), ("q1", 2, "b"), ("q2", 1, "c")],
                                 "query_id string, rank int, doc_id string")
    gold = spark.createDataFrame([("q1", "b"), ("q2", "z"), ("q3", "a")], "query_id string, doc_id string")
    acc = {r["k"]: (r["accuracy"], r["n"]) for r in evaluate.accuracy_at_k(hits, gold, ks=(1, 2)).collect()}
    assert acc[1] == (0.0, 3) and acc[2] == (round(100 / 3, 6), 3)
    failed = {r["query_id"]: r["returned"] for r in evaluate.failed_queries(hits, gold, k=1).collect()}
    assert failed == {"q1": "a", "q2": "c", "q3": ""}
    dup = spark.createDataFrame([("q1", "a"), ("q1", "b"), ("q2", "c"), ("q2", "c")], "query_id string, doc_id string")
    with pytest.raises(Exception, match="several gold"):
        evaluate.check_gold(dup).collect()
    assert evaluate.check_gold(dup.where("query_id = 'q2'")).collect() == [("q2", "c")]


def test_any_gold_document_is_a_hit(spark):
    hits = spark.createDataFrame([("q1", 1, "a"), ("q1", 2, "b"), ("q2", 1, "c")], "query_id string, rank int, doc_id string")
    gold = spark.createDataFrame([("q1", "z"), ("q1", "b"), ("q1", "a"), ("q2", "x"), ("q2", "y")],
                                 "query_id string, doc_id string")
    acc = {r["k"]: (r["accuracy"], r["n"]) for r in evaluate.accuracy_at_k(hits, gold, ks=(1, 2)).collect()}
    assert acc == {1: (50.0, 2), 2: (50.0, 2)}
    assert [tuple(r) for r in evaluate.failed_queries(hits, gold, k=2).collect()] == [("q2", "c")]


@pytest.mark.parametrize("qrows,xrows", [(None, None), (9, 40), (200, 7)])
def test_knn_more_ties_than_k(spark, qrows, xrows):
    """Hundreds of equal and zero vectors at the boundary: ids decide, whatever the grid."""
    rng = np.random.default_rng(5)
    X = np.concatenate([np.tile(rng.normal(size=(1, 6)), (150, 1)), np.zeros((80, 6)),
                        rng.normal(size=(40, 6))]).astype(np.float32)
    ids = rng.permutation(len(X)) + 1000
    df = _frame(spark, ids, X, "vec_id")
    q = df.withColumnRenamed("vec_id", "query_id").where("query_id % 3 = 0")
    got = vectors.knn(q, df, 10, exclude_self=True, q_block_rows=qrows, x_block_rows=xrows)
    keep = ids % 3 == 0
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id").collect()) == \
        brute(ids[keep], X[keep], ids, X, 10, True)


def test_index_positions_go_on_after_an_append(spark):
    rows = [(f"k{i:02d}", f"d{i}", [float(i), 1.0]) for i in range(20)]
    enc = spark.createDataFrame(rows, "key string, doc_id string, embedding array<double>")
    first = vectors.build_index(enc.where("key < 'k07'"), "key")
    whole, = vectors.append_noise(enc, [first])  # the first keys are there already
    got = sorted((r["vec_id"], r["key"], r["origin"]) for r in whole.collect())
    assert got == [(i, f"k{i:02d}", "gold" if i < 7 else "noise") for i in range(20)]
    assert {r["origin"]: r["n"] for r in vectors.index_stats(whole).collect()} == {"gold": 7, "noise": 13, "__all__": 20}


def test_grouped_knn_searches_within_group(spark):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(40, 4)).astype(np.float32)
    groups = ["a" if i % 3 else "b" for i in range(40)]
    rows = [(g, int(i), [float(x) for x in v]) for i, (g, v) in enumerate(zip(groups, X))]
    idx = spark.createDataFrame(rows, "config string, vec_id long, embedding array<float>")
    q = idx.withColumnRenamed("vec_id", "query_id")
    got = vectors.knn(q, idx, 3, exclude_self=True, group="config", x_block_rows=7, q_block_rows=5)
    got = sorted(tuple(r) for r in got.select("config", "query_id", "rank", "vec_id").collect())
    expect = []
    for g in ("a", "b"):
        ids = np.array([i for i in range(40) if groups[i] == g])
        expect += [(g,) + t for t in brute(ids, X[ids], ids, X[ids], 3, True)]
    assert got == sorted(expect)


def test_knn_many_reducer_partitions(spark):
    """Cells must meet across many shuffle partitions (AQE coalescing off):
    cell keys of both sides need identical types."""
    rng = np.random.default_rng(11)
    X = rng.normal(size=(120, 5)).astype(np.float32)
    df = _frame(spark, range(120), X, "vec_id")
    q = df.withColumnRenamed("vec_id", "query_id")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = vectors.knn(q, df, 4, exclude_self=True, parallelism=8, q_block_rows=50, x_block_rows=30)
        got = sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id").collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute(np.arange(120), X, np.arange(120), X, 4, True)


def test_sql_and_arrow_encoders_agree(spark):
    from passagekit.operators import models
    df = spark.createDataFrame([(1, "The cat sat on the mat"), (2, ""), (3, "Ünïcode wörds and  double  spaces")],
                               "k long, text string")
    a = {r["k"]: r["embedding"] for r in models.encode(df, "k", "text", dim=16).collect()}
    s = {r["k"]: r["embedding"] for r in models.encode(df, "k", "text", dim=16, engine="sql").collect()}
    assert a.keys() == s.keys()
    for k in a:
        assert np.allclose(a[k], s[k], atol=1e-12)


def test_knn_grid_shapes_property(spark):
    """Any grid shape and k give the brute-force answer (ties broken by id)."""
    from hypothesis import given, settings, HealthCheck
    from hypothesis import strategies as st

    @settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.integers(1, 40), st.integers(1, 40), st.integers(1, 12), st.integers(0, 10_000),
           st.booleans())
    def check(qrows, xrows, k, seed, dup):
        rng = np.random.default_rng(seed)
        X = rng.integers(-3, 4, size=(35, 3)).astype(np.float32)   # small integers: many exact ties
        if dup:
            X[5] = X[6] = X[7]
        df = _frame(spark, range(35), X, "vec_id")
        q = df.withColumnRenamed("vec_id", "query_id")
        got = vectors.knn(q, df, k, exclude_self=True, q_block_rows=qrows, x_block_rows=xrows, parallelism=3)
        got = sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id").collect())
        assert got == brute(np.arange(35), X, np.arange(35), X, k, True)

    check()


def test_rows_travel_by_tile_not_by_cell(spark, monkeypatch):
    """Small cells do not multiply the rows that are shuffled: every vector of one tile is sent once."""
    import pandas as pd

    def counted(*_):
        def run(q, x):
            return pd.DataFrame({"g": [""], "q": [len(q)], "x": [len(x)], "d2": [0.0]})
        return run

    monkeypatch.setattr(vectors, "_cell_topk", counted)
    df = _frame(spark, range(200), np.eye(200, 4, dtype=np.float32), "vec_id")
    q = df.withColumnRenamed("vec_id", "query_id")
    sent = vectors.knn(q, df, 9, q_block_rows=8, x_block_rows=8, parallelism=1).collect()
    assert [(r["query_id"], r["vec_id"]) for r in sent] == [(200, 200)]


def test_kept_lists_are_cut_back(monkeypatch):
    """Equal vectors beyond number: the lists of a search stay bounded and ids decide."""
    monkeypatch.setattr(vectors, "CELL_NUMBERS", 800)
    x, ids = np.zeros((5000, 2)), np.random.default_rng(2).permutation(5000)
    near = vectors.Nearest(x[:40], ids[:40], x, ids, 3, True)
    lengths, cut = [], near._cut
    near._cut = lambda kept: lengths.append(sum(len(r) for r, _, _ in kept)) or cut(kept)
    rows, cols, d2 = near.search(0, 40, ((None, a, a + 100) for a in range(0, 5000, 100)))
    assert max(lengths) <= 2 * 4096 + 40 * 100 and not d2.any()
    want = [[i for i in range(4) if i != own][:3] for own in ids[:40]]
    assert ids[cols].reshape(40, 3).tolist() == want and rows.tolist() == sorted(list(range(40)) * 3)
