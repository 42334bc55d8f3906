"""Runs of words against all periods of all stretches, and the registered query against plain Python."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from passagekit.llm import runs
from passagekit.llm.queries import op11_runs

COLUMNS = "doc_id long, text string, n_words string, runs long, _text long"


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[:len(words) - q])


def brute(words, least=12):
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        a = 0
        while a + q < n:
            b = a
            while b + q < n and words[b] == words[b + q]:
                b += 1
            length = b + q - a
            if b > a and length >= max(least, 2 * q) and smallest_period(words[a:a + length]) == q:
                out.append((a, length, q))
            a = max(b, a + 1) if b > a else a + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words, found):
    drop = {k for a, n, q in found for k in range(a + q, a + n)}
    return " ".join(w for k, w in enumerate(words) if k not in drop)


def shapes(seed=5):
    rng = random.Random(seed)
    out = []
    for k in range(150):
        n, v = rng.randint(0, 90), rng.choice([1, 2, 2, 3, 6])
        words = [rng.choice("abcdef"[:v]) for _ in range(n)]
        if k % 3 == 0:
            root = [rng.choice("abc") for _ in range(rng.randint(1, 15))]
            words = words[:20] + root * rng.randint(2, 6) + words[20:]
        out.append(words)
    a, b = ["a"], ["b"]
    for _ in range(8):  # Fibonacci words hold very many runs
        a, b = a + b, a
    return [*out, a, ["x"] * 12, ["x"] * 11, ["x", "y"] * 6, list("abcdefabcdef"), list("abcdefgabcdefg"), list("abcdef" * 2 + "a")]


def test_runs_of_sequences():
    for words in shapes():
        known = {}
        ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
        assert list(map(tuple, runs.runs_of_documents([ids])[0].tolist())) == brute(words), words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4))
def test_documents_side_by_side(documents):
    got = runs.runs_of_documents([np.array(d, np.int64) for d in documents])
    assert [list(map(tuple, g.tolist())) for g in got] == [brute(d) for d in documents]


def test_small_trees_give_the_same(monkeypatch):
    documents = [np.array([ord(w[0]) for w in words], np.int64) for words in shapes(7)]
    want = [x.tolist() for x in runs.runs_of_documents(documents)]
    monkeypatch.setattr(runs, "TREE_SYMBOLS", 50)
    assert [x.tolist() for x in runs.runs_of_documents(documents)] == want


def test_common_extensions():
    rng = random.Random(2)
    text = [rng.randint(0, 1) for _ in range(200)] + [2]
    ext = runs.Extensions(text)
    a, b = np.array([rng.randrange(201) for _ in range(500)]), np.array([rng.randrange(201) for _ in range(500)])
    for x, y, got in zip(a.tolist(), b.tolist(), ext.common(a, b).tolist()):
        want = next((k for k in range(201) if max(x, y) + k >= 201 or text[x + k] != text[y + k]), None)
        assert got == want
    assert np.argsort(ext.rank).tolist() == sorted(range(201), key=lambda k: text[k:])


def test_table_with_nulls_repeats_and_clashing_names(spark):
    rows = [(1, None), (2, ""), (3, " \t "), (4, "one two"), (5, "na " * 40), (5, "na " * 40), (None, "a b " * 9),
            (6, "x\x1cy x\x85y " * 6), (7, "intro " + "de l’été, " * 20 + "end")]
    df = spark.createDataFrame([(i, t, "n", 1, 2) for i, t in rows], COLUMNS)
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in
                 runs.find_runs(df.select("doc_id", "text", "_text"), carry=["doc_id"]).collect())
    want = []
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        want.append((i or 0, len(words), brute(words), collapse(words, brute(words))))
    assert got == sorted(want)
    assert runs.find_runs(df.limit(0)).collect() == []


def test_very_long_text(spark):
    text = "a b c " * 30_000 + " ".join(str(k) for k in range(50_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = runs.find_runs(df).first()
    assert [tuple(r) for r in row.runs] == [(0, 90_000, 3)] and len(row.collapsed.split()) == 50_003


def plain_query(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute(words)
    top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    return (doc_id, len(found), *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None,
            sha256("".join(f"{a},{b},{q}\n" for a, b, q in found).encode()).hexdigest(),
            sha256(collapse(words, found).encode()).hexdigest())


def test_registered_query_on_a_fixture(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 120)))) for k in range(300)]
    rows += [(300, None), (301, ""), (None, "a a " * 20), (5, "dup dup " * 10)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op11_runs(spark, str(tmp_path)).drop("n_words").collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain_query(*r) for r in rows), key=repr)
    assert sum(r.n_runs > 0 for r in got) > 10
