"""Merkle manifest against a plain tree built from lists."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from passagekit.llm import merkle

COLUMNS = "doc_id long, lang string, leaf string, path string, root string, _tree int"


def sha(text):
    return sha256(text.encode()).hexdigest()


def climb(level):
    """All levels from the leaves to the one node that remains."""
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k:k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 8 * 8
        out.append(("".join(level[run:at]), "".join(level[at + 1:run + 8])))
        at //= 8
    return out


def brute(rows):
    groups = {}
    for i, lang, leaf in rows:
        groups.setdefault(lang, []).append((i is not None, i or 0, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [climb([leaf for *_, leaf in sorted(groups[g])]) for g in order]
    top = climb([t[-1][0] for t in trees])
    out = []
    for k, (g, tree) in enumerate(zip(order, trees)):
        for at, (known, i, leaf) in enumerate(sorted(groups[g])):
            out.append((i if known else None, leaf, tree[-1][0], top[-1][0], tuple(path(tree, at) + path(top, k))))
    return sorted(out, key=repr)


def got(spark, rows):
    df = spark.createDataFrame([(i, g, h, "p", "r", 1) for i, g, h in rows], COLUMNS)
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple(map(tuple, r.path)))
                   for r in merkle.manifest(df).collect()), key=repr)


def case(sizes, seed=1, spread=5):
    rng = random.Random(seed)
    rows = []
    for g, n in sizes.items():
        ids = rng.sample(range(-n * spread, n * spread), n)
        rows += [(i, g, sha(f"{g}{i}")) for i in ids]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [
    {"en": 1}, {"en": 1, None: 1}, {"en": 8, "de": 9}, {"é": 65, "": 64, "z": 2}, {"en": 1300, None: 513, "fr": 512},
    {f"g{k}": 1 for k in range(70)}])
def test_trees_and_paths(spark, sizes):
    rows = case(sizes)
    assert got(spark, rows) == brute(rows)


def test_sparse_and_extreme_ids(spark):
    ids = [-2 ** 63, -2 ** 63 + 1, -1, 0, 63, 64, 65, 65535, 65536, 2 ** 32, 2 ** 48 + 1, 2 ** 63 - 1, None]
    rows = [(i, "en", sha(str(i))) for i in ids]
    assert got(spark, rows) == brute(rows)


def test_repeated_rows_null_ids_and_ties(spark):
    rows = [(7, "en", sha("same"))] * 40 + [(7, "en", sha(f"x{k}")) for k in range(30)]
    rows += [(None, "en", sha(f"n{k}")) for k in range(50)] + [(None, None, sha("n"))] * 3
    rows += case({"en": 100}, seed=2)
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_fold_detects_a_changed_leaf(spark):
    rows = case({"en": 20, "de": 3})
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string").withColumn(
        "claimed", F.when(F.col("doc_id") % 2 == 0, F.sha2("leaf", 256)).otherwise(F.col("leaf")))
    out = merkle.manifest(df, carry=["claimed"]).withColumn(
        "ok", merkle.fold(F.col("claimed"), F.col("path")) == F.col("root")).collect()
    assert len(out) == 23 and all(r.ok == (r.doc_id % 2 != 0) for r in out)


def test_leaf_fields(spark):
    row = spark.createDataFrame([(12, None, "é:A")], "a int, b string, c string").select(
        merkle.leaf_hash(F.col("a"), F.col("b"), F.col("c")).alias("h")).first()
    assert row.h == sha("2:12-4:é:A")
