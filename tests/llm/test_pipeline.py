"""The pipeline against brute force, and the registered queries against DuckDB."""

import random
from collections import defaultdict

import duckdb
import pytest
from test_minhash import brute

import corpus_pipeline
from passagekit.llm import queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, c0 string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows, labels):
        docs = spark.createDataFrame([(*r, "s", 1, 0.5, True, "x") for r in rows], DOCS)
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)
    return write


def rows_and_labels(seed=5):
    rng = random.Random(seed)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(2, 6)))
    rows, labels = [], []
    for i in range(500):
        lang = "ab"[i % 2]
        words = [word("aeioust" if lang == "a" else "bkmnrz") for _ in range(rng.randint(30, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["stuupid", "wretchhed"]))
        rows.append((i, " ".join(words), lang))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_pipeline_is_brute_force(spark, folder):
    rows, labels = rows_and_labels()
    clean = [r for r in rows if r[0] % 5]
    extra = [(1000 + i, r[1], r[2]) for i, r in enumerate(clean[:20])]                      # copies
    extra += [(2000 + i, r[1] + " end", r[2]) for i, r in enumerate(clean[10:40])]           # near copies
    extra += [(3000, None, "a"), (3001, "", "a"), (3002, "1 2 3 !", "a"), (None, "aeiou " * 30, None)]
    extra += [(3, rows[3][1], "b")]                                                          # a repeated row
    path = folder(rows + extra, labels)
    docs = spark.read.parquet(f"{path}/documents.parquet")

    # decisions by brute force: toxic by construction, no letter, the largest id of equal texts, near copies
    left = [(i, t) for i, t, _ in rows + extra if not (t and ("stuupid" in t or "wretchhed" in t))]
    left = [(i, t) for i, t in left if t and any(map(str.isalpha, t))]
    groups = defaultdict(list)
    for i, t in left:
        groups[t].append(i)
    left = [(max(own, key=lambda i: -1 if i is None else i), t) for t, own in groups.items()]
    want = sorted((i for i, _, _, kept in brute(left) if kept), key=str)

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == DOCS.replace(",", "").split()[::2], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert sorted((r.doc_id for r in docs.collect()), key=str) == want
    packed = corpus_pipeline.run(spark, path).collect()
    assert sorted({r.doc_id for r in packed}, key=str) == want
    assert sum(r.length for r in packed) == sum({r.doc_id: r.doc_tokens for r in packed}.values())


def test_pipeline_on_an_empty_table(spark, folder):
    assert corpus_pipeline.run(spark, folder([], [])).collect() == []


def test_near_copies_of_a_repeated_id(spark, folder):
    words = " ".join(f"w{k}" for k in range(80))
    path = folder([(1, words, "a"), (5, words + " x", "a"), (5, "another text " * 9, "a"), (None, words + " y", "a")], [])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = corpus_pipeline.drop_near_copies(spark, docs, path).collect()
    assert sorted((r.doc_id, r.text[:5]) for r in got) == [(1, "w0 w1"), (5, "anoth")]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, SF)
    columns = want.columns
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_give_a_row_per_document(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    if name in ("op1_chat", "op7_topk"):
        assert len(got)
    elif name == "op2_packing":
        assert set(got["doc_id"]) == set(docs["doc_id"])
    else:
        assert sorted(got["doc_id"]) == sorted(docs["doc_id"])
