"""Pruned exact k-NN, vectors that take no part, and all occurrences of items."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagekit.operators import occurrences, pruned, textprep, vectors

VECS = "vec_id long, embedding array<double>"


def rows_of(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", F.round("d2", 9).alias("d2")).collect())


def clustered(n, clusters, seed=1, width=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 100, (clusters, width))
    return [(k, (centres[k % clusters] + rng.normal(0, 1, width)).tolist()) for k in range(n)]


def both(spark, rows, k, queries=None, **kw):
    index = spark.createDataFrame(rows, VECS)
    q = (spark.createDataFrame(queries, VECS) if queries is not None else index).withColumnRenamed("vec_id", "query_id")
    own = queries is None
    hits, work = pruned.knn_pruned(q, index, k, exclude_self=own, **kw)
    return rows_of(hits), rows_of(vectors.knn(q, index, k, exclude_self=own)), work.first()


def test_pruned_equals_the_grid_and_visits_less(spark):
    rows = clustered(600, 12)
    got, want, work = both(spark, rows, 5)
    assert got == want and len(got) == 3000
    assert work.n_queries == work.n_index == 600 and work.distances < 600 * 599 / 4


@pytest.mark.parametrize("case", ["copies", "few", "one", "far query", "blocks", "one pivot"])
def test_pruned_edge_shapes(spark, case):
    rng = random.Random(3)
    rows, k, queries, kw = clustered(120, 5, 2), 7, None, {}
    if case == "copies":  # a third of all vectors are one vector
        rows = rows[:80] + [(1000 + j, rows[0][1]) for j in range(40)]
    elif case == "few":
        rows, k = rows[:4], 10
    elif case == "one":
        rows, k = rows[:1], 3
    elif case == "far query":
        queries = [(5, [1e6] * 8), (6, [0.0] * 8), (7, rows[3][1])]
    elif case == "blocks":
        kw = {"block_rows": 7}
    else:
        kw = {"pivots": 1}
    rng.shuffle(rows)
    got, want, _ = both(spark, rows, k, queries, **kw)
    assert got == want


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [float(k), 1.0]) for k in range(6)]
    bad = [(90, None), (91, [nan, 1.0]), (92, [None, 1.0]), (93, [1.0, inf]), (94, [-inf, nan])]
    index = spark.createDataFrame(good + bad, VECS)
    q = index.withColumnRenamed("vec_id", "query_id")
    want = rows_of(vectors.knn(q.where("query_id < 90"), index.where("vec_id < 90"), 3))
    assert rows_of(vectors.knn(q, index, 3)) == want and len(want) == 18
    assert rows_of(pruned.knn_pruned(q, index, 3)[0]) == want
    assert rows_of(pruned.knn_pruned(q, index.limit(0), 3)[0]) == []


def plain_lines(docs, items):
    out = set()
    for d, text in docs:
        for i, item in items:
            at = (text or "").find(item) if item else -1
            while at >= 0:
                out.add((d, i, text.count("\n", 0, at)))
                at = text.find(item, at + 1)
    return sorted(out)


def test_every_occurrence_line_of_every_item(spark):
    rng = random.Random(6)
    docs = [(k, "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 60)))) for k in range(40)]
    docs += [(100, None), (101, ""), (102, "gold é line\nother\ngold é line and gold é line\n\ngold é line"), (102, "gold")]
    items = [(k, "".join(rng.choice("ab \n") for _ in range(rng.randint(1, 5)))) for k in range(60)]
    items += [(200, "gold é line"), (201, "gold é line"), (202, "aa"), (203, None), (204, ""), (205, "é"), (206, "line\no")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain_lines(docs, items)
    for chars in (occurrences.PART_CHARS, 40):  # one part, many parts
        got = sorted(tuple(r) for r in occurrences.occurrence_lines(d, i, part_chars=chars).collect())
        assert got == want
    assert [r for r in want if r[:2] == (102, 200)] == [(102, 200, 0), (102, 200, 2), (102, 200, 4)]
    assert occurrences.occurrence_lines(d, i.where("item_id in (203, 204)")).collect() == []


def plain_segments(text, most):
    out = []
    for p in (text or "").split("\n"):
        if p:
            c = len([w for w in p.split(" ")])
            if not out or out[-1][1] >= most:
                out.append([p, c])
            else:
                out[-1] = [out[-1][0] + " " + p, out[-1][1] + c]
    return [tuple(x) for x in out]


def test_segments_of_many_paragraphs(spark):
    rng = random.Random(9)
    texts = ["\n".join("w " * rng.randint(0, 6) + "x" for _ in range(n)) for n in (0, 1, 5, 200, 900)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (1, 4, 50):
        got = {}
        for r in textprep.pack_segments(df, max_tokens=most).orderBy("doc_id", "seg_id").collect():
            got.setdefault(r.doc_id, []).append((r.segment, r.n_tokens))
        assert got == {k: plain_segments(t, most) for k, t in enumerate(texts) if t}


def test_long_texts_stay_close_to_linear(spark):
    import time

    def seconds(n):
        text = "\n".join(f"Name{k} Other{k} went on." for k in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        textprep.pack_segments(df, max_tokens=1).write.format("noop").mode("overwrite").save()
        textprep.with_entity_choices(df, "doc_id", "text").write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds(500)
    assert seconds(16_000) < 3.2 * seconds(8_000) + 1


def test_a_query_is_routed_once_per_block(spark):
    """Where no cell can be left out, a query travels once to every block of rows, not to every cell."""
    import pandas as pd
    rng = np.random.default_rng(4)
    points, sizes = rng.normal(size=(50, 3)), np.full(50, 10)
    begin = pruned._spread(sizes, pruned._line_up(points))
    batch = pd.DataFrame({"q": range(20), "v": list(rng.normal(size=(20, 3))), "bound": np.inf,
                          "first": [np.array([k], np.int32) for k in range(20)]})
    for rows, blocks in ((500, 1), (130, 4), (7, 72)):
        out = pd.concat(pruned._router(points, sizes, np.zeros(50), np.full(50, 9.0), 4, True, begin, rows)([batch]))
        assert out.groupby("q").size().max() <= blocks and not out.duplicated(["q", "xb"]).any()
        for q, own in out.groupby("q"):
            assert set(np.concatenate(own["cells"].to_list())) == set(range(50)) - {q} and own["work"].sum() == 490


def test_pruned_without_clusters_equals_the_grid(spark):
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(300)]
    got, want, work = both(spark, rows, 5, block_rows=64)
    assert got == want and work.distances <= 300 * 300
