"""Curation operators against plain-Python brute force on hand cases."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from passagekit.operators import curate


def brute_collapse(rows, n):
    """rows: (doc, num, key, title, text); reference semantics."""
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    index = {(r[0], r[1]): r for r in rows}
    out = []
    for doc, rs in by.items():
        rs.sort(key=lambda r: r[1])
        for pos, a in enumerate(rs, start=1):
            if pos % n != 1 % n:
                continue
            members = [a]
            cur = a
            for _ in range(n - 1):
                nxt = index.get((doc, cur[1] + 1))
                if nxt is None:
                    break
                members.append(nxt)
                cur = nxt
            clean = [m[4].replace("\r", " ").replace("\n", " ") for m in members]
            out.append((doc, ",".join(m[2] for m in members), a[3], " ".join(clean), a[1]))
    return sorted(out)


ROWS = [
    ("d1", 1, "k1", "T", "a"), ("d1", 2, "k2", "T", "b\r\nb"), ("d1", 3, "k3", "T", "c"),
    ("d2", 1, "k4", "U", "x"), ("d2", 3, "k5", "U", "y"), ("d2", 4, "k6", "U", "z"),
    ("d3", 7, "k7", "V", "only"),
    ("d4", 1, "k8", "W", "p"), ("d4", 2, "k9", "W", "q"), ("d4", 5, "k10", "W", "r"), ("d4", 6, "k11", "W", "s"),
]


def _df(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, num long, corpus_id string, title string, text string")


def test_collapse_levels_match_reference_semantics(spark):
    df = _df(spark, ROWS)
    for n in (1, 2, 3):
        got = curate.collapse_passages(df, n).select(
            "doc_id", F.array_join("corpus_id_array", ","), "title", "doc_text", "first_num").collect()
        assert sorted(tuple(r) for r in got) == brute_collapse(ROWS, n), n


def test_collapse_across_chunks(spark):
    rows = [("d", i, f"k{i}", "T", f"t{i}") for i in list(range(0, 40)) + list(range(50, 63))]
    df = _df(spark, rows)
    pos = curate.group_positions(df, "doc_id", ["num"])
    ref = df.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("num")))
    assert sorted(pos.select("num", "pos").collect()) == sorted(ref.select("num", "pos").collect())
    got = curate.collapse_passages(df, 3).select(
        "doc_id", F.array_join("corpus_id_array", ","), "title", "doc_text", "first_num").collect()
    assert sorted(tuple(r) for r in got) == brute_collapse(rows, 3)


def test_collapse_null_text_gives_null(spark):
    df = _df(spark, [("d", 1, "a", "T", "x"), ("d", 2, "b", "T", None)])
    r = curate.collapse_passages(df, 2).collect()
    assert len(r) == 1 and r[0]["doc_text"] is None


def test_dense_ids_nulls_first_and_shared(spark):
    rows = [(1, None, "t"), (2, None, "u"), (3, "", "v"), (4, "b", "b"), (5, "a", "ab text"), (6, "a", "a text")]
    df = spark.createDataFrame(rows, "id long, title string, text string").repartition(3)
    out = {r["id"]: r["doc_id"] for r in curate.assign_doc_ids(df, "title", prefix="w_").collect()}
    assert out[1] == out[2] == "w_1"
    assert out[3] == "w_2" and out[5] == out[6] == "w_3" and out[4] == "w_4"


def test_dense_index_many_partitions(spark):
    vals = [f"t{i % 37:03d}" for i in range(500)]
    df = spark.createDataFrame([(v,) for v in vals], "title string")
    got = {r["title"]: r["rank"] for r in curate.dense_index(df, "title", partitions=7).collect()}
    expect = {v: i + 1 for i, v in enumerate(sorted(set(vals)))}
    assert got == expect


def test_curate_prefix_and_repair(spark):
    rows = [(1, None, "text"), (2, "", "xtext"), (3, "Title", "Title body"), (4, "Title", "Titlebody"),
            (5, "Same", "Same")]
    df = spark.createDataFrame(rows, "id long, title string, text string")
    out = {r["id"]: (r["title"], r["text"]) for r in curate.curate_passages(df).collect()}
    assert out[1] == ("NaN", "text")
    assert out[2] == ("", "xtext")          # empty title: text kept whole
    assert out[3] == ("Title", "body")
    assert out[4] == ("Title", "ody")       # reference drops one separator char blindly
    assert out[5] == ("Same", "")


def test_dedup_numeric_order(spark):
    rows = [("d", "T", "same", "doc10", 10), ("d", "T", "same", "doc9", 9), ("d", "T", "other", "doc11", 11)]
    df = spark.createDataFrame(rows, "doc_id string, title string, text string, corpus_id string, num long")
    out = curate.dedup_passages(df, ["doc_id", "title", "text"], "num").collect()
    got = {r["text"]: r["corpus_id"] for r in out}
    assert got == {"same": "doc9", "other": "doc11"}
    again = curate.dedup_passages(curate.dedup_passages(df, ["doc_id", "title", "text"], "num"),
                                  ["doc_id", "title", "text"], "num")
    assert sorted(again.collect()) == sorted(out)


def test_hot_title_and_hot_document(spark):
    """One title / one document holding a third of all rows: ids and positions
    stay exact (positions come from range partitions, ids from distinct titles)."""
    rows = [("hot", i, f"line {i}") for i in range(300)] + \
           [(f"t{j}", 1000 + j, f"other {j}") for j in range(600)]
    df = spark.createDataFrame(rows, "title string, num long, text string").repartition(5)
    ids = curate.assign_doc_ids(df, "title", prefix="d_")
    per_title = ids.groupBy("title").agg(F.countDistinct("doc_id").alias("n")).where("n > 1").count()
    assert per_title == 0 and ids.select("doc_id").distinct().count() == 601
    pos = curate.group_positions(ids, "doc_id", ["num"])
    hot = sorted((r["num"], r["pos"]) for r in pos.where("title = 'hot'").collect())
    assert [p for _, p in hot] == list(range(1, 301))


def brute_collapse_runs(rows, n):
    """Numbering restarts at every id gap; every passage ends up in a group."""
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out = []
    for doc, rs in by.items():
        rs.sort(key=lambda r: r[1])
        runs, cur = [], [rs[0]]
        for a, b in zip(rs, rs[1:]):
            if b[1] == a[1] + 1:
                cur.append(b)
            else:
                runs.append(cur)
                cur = [b]
        runs.append(cur)
        for run in runs:
            for i in range(0, len(run), n):
                g = run[i:i + n]
                clean = [m[4].replace("\r", " ").replace("\n", " ") for m in g]
                out.append((doc, ",".join(m[2] for m in g), g[0][3], " ".join(clean), g[0][1]))
    return sorted(out)


def test_collapse_runs_policy(spark):
    df = _df(spark, ROWS)
    for n in (2, 3):
        got = curate.collapse_passages(df, n, policy="runs").select(
            "doc_id", F.array_join("corpus_id_array", ","), "title", "doc_text", "first_num").collect()
        assert sorted(tuple(r) for r in got) == brute_collapse_runs(ROWS, n), n
        covered = sorted(k for r in got for k in r[1].split(","))
        assert covered == sorted(r[2] for r in ROWS)      # no passage lost


def test_collapse_level_one_is_identity_up_to_newlines(spark):
    df = _df(spark, ROWS)
    got = sorted((r["doc_id"], r["corpus_ids"], r["doc_text"]) for r in curate.collapse_passages(df, 1).select(
        "doc_id", F.array_join("corpus_id_array", ",").alias("corpus_ids"), "doc_text").collect())
    expect = sorted((r[0], r[2], r[4].replace("\r", " ").replace("\n", " ")) for r in ROWS)
    assert got == expect


def test_collapse_series_over_one_title(spark):
    """Many source documents share one title (one doc_id): lines only follow each
    other inside a source, positions run over all of them."""
    rows = [("hot", s, n, f"{s}_{n}", "T", f"text {s} {n}") for s in range(120) for n in range(s % 5)]
    df = spark.createDataFrame(rows, "doc_id string, src long, num int, corpus_id string, title string, text string")
    got = curate.collapse_passages(df.repartition(7), 2, series="src").collect()
    at = {(r[1], r[2]): r for r in rows}
    want = []
    for place, key in enumerate(sorted(at)):
        if place % 2 == 0:
            follow = at.get((key[0], key[1] + 1))
            want.append((*key, [at[key][3]] + ([follow[3]] if follow else [])))
    assert sorted((r["src"], r["first_num"], r["corpus_id_array"]) for r in got) == want


def test_collapse_rejects_repeated_ids(spark):
    import pytest
    df = _df(spark, [("d", 1, "a", "T", "x"), ("d", 1, "b", "T", "y")])
    with pytest.raises(Exception, match="occurs twice"):
        curate.collapse_passages(df, 2).collect()


def test_dedup_by_pair(spark):
    df = spark.createDataFrame([("t", 2, 1, "b"), ("t", 1, 9, "a"), ("t", 1, 10, "c")],
                               "text string, src long, num int, key string")
    assert [r["key"] for r in curate.dedup_passages(df, ["text"], ["src", "num"]).collect()] == ["a"]


def test_collapse_with_given_positions_copies_a_text_once(spark):
    df = _df(spark, ROWS)
    placed = curate.group_positions(df, "doc_id", ["num"]).withColumnRenamed("pos", "place")
    for n in (1, 2, 3, 4):
        got = curate.collapse_passages(placed, n, positions="place")
        assert sorted(tuple(r) for r in got.select("doc_id", F.array_join("corpus_id_array", ","), "title", "doc_text",
                                                   "first_num").collect()) == brute_collapse(ROWS, n), n
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array_distinct(array(0, " in plan and "sequence(0" not in plan
