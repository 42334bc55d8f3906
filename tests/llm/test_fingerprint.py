"""Document fingerprints against a plain construction of the same scheme, and against exact likeness."""

import random
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from passagekit.llm import fingerprint
from passagekit.llm.queries import op12_fingerprint

DOCS = "doc_id long, text string, fingerprint string, _tokens long"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def exact(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def spark_hashes(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    return {r.k: list(r._hashes) for r in fingerprint.with_hashes(df, F.col("text")).collect()}


def walks(spark):
    """Hashes of (bin, step) and of (bin, 0, bin), as the SQL functions give them."""
    b = fingerprint.BINS
    first = {(r.i, r.t): r.j for r in spark.range(b).crossJoin(spark.range(1, fingerprint.STEPS + 1).toDF("t")).select(
        F.col("id").alias("i"), "t", F.pmod(F.xxhash64(F.col("id").cast("int"), F.col("t").cast("int")), F.lit(b)).alias("j")).collect()}
    rest = {(r.i, r.j): r.o for r in spark.range(b).crossJoin(spark.range(b).toDF("j")).select(
        F.col("id").alias("i"), "j", F.xxhash64(F.col("id").cast("int"), F.lit(0), F.col("j").cast("int")).alias("o")).collect()}
    return first, rest


def brute(hashes, first, rest):
    if not hashes:
        return ""
    bins = {}
    for h in hashes:
        b = (h >> 64 - fingerprint.BIN_BITS) + fingerprint.BINS // 2
        bins[b] = min(bins.get(b, h), h)
    out = []
    for i in range(fingerprint.BINS):
        j = i
        if j not in bins:
            j = next((first[i, t] for t in range(1, fingerprint.STEPS + 1) if first[i, t] in bins), None)
            if j is None:
                j = min(bins, key=lambda x: rest[i, x])
        out.append("%02x" % (bins[j] & 255))
    return "".join(out)


def texts(seed=1, n=40):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    return [None, "", " \n", "one", "One two", "a b c d e", "É É é"] + [
        " ".join(rng.choice(words) for _ in range(rng.choice([3, 8, 30, 200, 1500]))) for _ in range(n)]


def test_bins_and_densification(spark):
    cases = texts()
    first, rest = walks(spark)
    hashes = spark_hashes(spark, cases)
    df = spark.createDataFrame([(k, t, "x", 3) for k, t in enumerate(cases)], DOCS)
    got = {r[0]: r[4] for r in fingerprint.fingerprints(df).collect()}
    assert got == {k: brute(hashes[k], first, rest) for k in range(len(cases))}
    assert all(len(h) == len(set(h)) or len(shingles(cases[k])) < len(h) for k, h in hashes.items())


def test_words_are_cut_at_ascii_blanks_only(spark):
    got = spark_hashes(spark, ["a\x1cb c\x85d\xa0e", "a\x1cB \t\r\n\x0b\x0cc\x85d\xa0e ", "a b c d e f", "x y a b c d e f"])
    assert got[0] == got[1] and len(got[2]) == 2 and set(got[2]) < set(got[3])


def test_likeness_follows_the_share_of_common_shingles(spark):
    rng = random.Random(8)
    pairs = []
    for share in (0, 0.1, 0.3, 0.5, 0.8, 0.95, 1):
        for _ in range(12):
            a = [f"w{rng.randrange(5000)}" for _ in range(600)]
            cut = int(600 * share)
            pairs.append((" ".join(a), " ".join(a[:cut] + [f"v{rng.randrange(5000)}" for _ in range(600 - cut)])))
    df = spark.createDataFrame(pairs, "a string, b string")
    df = fingerprint.with_fingerprint(fingerprint.with_fingerprint(df, F.col("a"), "x"), F.col("b"), "y")
    errors = [r.near - exact(r.a, r.b) for r in df.select("a", "b", fingerprint.likeness(F.col("x"), F.col("y")).alias("near")).collect()]
    assert max(map(abs, errors)) < 0.2 and abs(sum(errors)) / len(errors) < 0.02
    same = [r.near for r in df.select(fingerprint.likeness(F.col("x"), F.col("x")).alias("near")).collect()]
    assert set(same) == {1.0}


def plain(rows):
    """(doc_id, n_chars, edited sha) and the texts that are compared, of every row."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), sha256(f"{'-' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()))
    out = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        takes = len(t) // 3
        out.append((i, len(t), t, t[:len(t) - takes] + after[:takes], after))
    return out


@pytest.mark.parametrize("rows", [
    [], [(1, "only one")], [(1, None)], [(3, "abc"), (1, ""), (2, "xyzxyz")],
    [(5, "same words here")] * 4 + [(5, "other"), (None, "null id text"), (None, "second"), (-9, "é" * 10), (2 ** 62, "big")],
])
def test_edited_texts_follow_the_order(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op12_fingerprint(spark, str(tmp_path)).collect()
    want = plain(rows)
    assert sorted((r.doc_id or 0, r.n_chars, r.edited_sha256) for r in got) == sorted(
        (i or 0, n, sha256(e.encode()).hexdigest()) for i, n, _, e, _ in want)


def test_whole_query_on_a_fixture(spark, tmp_path):
    rows = list(enumerate(texts(3, 60)))
    rows.append((500, rows[20][1]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op12_fingerprint(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    assert got[500].fingerprint == got[20].fingerprint
    for i, _, t, edited, after in plain(rows):
        if not shingles(t):
            assert got[i].fingerprint == "" and got[i].near_edited == float(not shingles(edited))
        elif min(len(shingles(t)), len(shingles(edited))) > 100:
            assert abs(got[i].near_edited - exact(t, edited)) < 0.2
            assert abs(got[i].near_next - exact(t, after)) < 0.2
