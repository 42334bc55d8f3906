"""MinHash near-duplicates against all pairs on full sets."""

import random
import re

import numpy as np
import pytest

from passagekit.llm import minhash

DOCS = "doc_id long, text string, n long, label long, cid long, kept boolean"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, False) for i, t in rows], DOCS)


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                up[root(a)] = root(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(k)]
        least = min((x for x in ids if x is not None), default=None)
        out.append((i, len(sets[k]), least, i == least))
    return sorted(out, key=str)


def corpus(seed, groups=25):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(1, 5)))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 8, 60, 200]))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.randint(1, 8)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = word()
            texts.append(rng.choice([" ", "\n"]).join(own))
    texts += texts[:5] + [t.upper() for t in texts[:3]]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_brute_force(spark, seed):
    rows = [(100 + 7 * i % 1000, t) for i, t in enumerate(corpus(seed))]
    got = minhash.near_duplicates(frame(spark, rows)).drop("text_hash").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_chain_of_edits_is_one_component(spark):
    rng = random.Random(3)
    words = [str(rng.random()) for _ in range(120)]
    rows = []
    for i in range(40):  # each is close to the next, far from the far ones
        rows.append((i, " ".join(words)))
        words[(i * 13) % 120] = str(rng.random())
    got = minhash.near_duplicates(frame(spark, rows)).drop("text_hash").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert {r.component_id for r in got} == {0}


def test_cases(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "one two"), (3, "One\x0btwo"), (9, "one\x1ctwo"), (None, "one two"),
            (None, "alone here"), (None, None), (4, "É x"), (2, "é x"), (11, "one two"), (11, "one two"),
            (12, "w " * 40000), (13, "w " * 5), (14, "x" * 100000)]
    got = minhash.near_duplicates(frame(spark, rows)).drop("text_hash").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert minhash.near_duplicates(frame(spark, [])).collect() == []


def test_recall_of_tables_at_the_threshold():
    """Half-bands of pairs at 0.85 meet on both sides; sketches stay within the limit."""
    rng = np.random.default_rng(4)
    met, near, trials = 0, 0, 400
    for _ in range(trials):
        own = rng.integers(1, 1 << 63, 740, dtype=np.uint64)
        a, b = own[:680 + 0], np.concatenate([own[60:]])  # 620 common of 740: 0.838
        x, y = minhash.min_hashes(a), minhash.min_hashes(b)
        h = minhash.half_bands(x) == minhash.half_bands(y)
        met += h[:minhash.HALVES].any() and h[minhash.HALVES:].any()
        apart = sum(bin((p ^ q) & (1 << 64) - 1).count("1") for p, q in zip(minhash.sketch(x), minhash.sketch(y)))
        near += apart <= minhash.BITS_APART
    assert met >= trials - 1 and near == trials


def test_long_texts_in_blocks(monkeypatch):
    own = np.random.default_rng(1).integers(1, 1 << 63, 5000, dtype=np.uint64)
    whole = minhash.min_hashes(own)
    monkeypatch.setattr(minhash, "COLUMNS_AT_ONCE", 100)
    assert (minhash.min_hashes(own) == whole).all()


@pytest.mark.parametrize("edges_a_task", [200_000, 20, 1])
def test_components_by_union_find(spark, monkeypatch, edges_a_task):
    monkeypatch.setattr(minhash, "EDGES_A_TASK", edges_a_task)
    rng = random.Random(9)
    edges = [(a, rng.randrange(a)) for a in range(1, 60) if a % 7] + [(100 + a, 101 + a) for a in range(25)]
    found = minhash.components(spark.createDataFrame(edges, "a long, b long"))
    up = {v: v for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(up[a], up[b])
            changed |= up[a] != low or up[b] != low
            up[a] = up[b] = low
    assert {r.v: r.label for r in found.collect()} == up


def test_common_counts_and_joining_links():
    rng = np.random.default_rng(2)
    base = rng.integers(1, 1 << 63, 60, dtype=np.uint64)
    sets = []
    for _ in range(70):  # many sets share most of the base, some little
        own = base[rng.random(60) < rng.choice([0.99, 0.9, 0.3])]
        sets.append(np.unique(np.concatenate([own, rng.integers(1, 40, 3, dtype=np.uint64)])))
    size = [len(s) for s in sets]
    got = minhash.common_counts(np.repeat(np.arange(70), size), np.concatenate(sets), 70)
    links = set()
    for a in range(70):
        for b in range(a + 1, 70):
            both = len(np.intersect1d(sets[a], sets[b]))
            assert got[a, b] == both
            if 100 * both >= 85 * (size[a] + size[b] - both):
                links.add((a, b))
    label = np.arange(70) // 2
    found = minhash.joining_links(np.arange(70), label, sets)
    assert set(found) <= links and len(found) < 35

    def groups(edges):
        up = {v: v for v in range(70)}

        def root(v):
            return v if up[v] == v else root(up[v])
        for x, y in edges:
            up[root(x)] = root(y)
        return [root(v) for v in range(70)]
    pairs = [(2 * k, 2 * k + 1) for k in range(35)]
    one, two = groups(pairs + sorted(links)), groups(pairs + found)
    assert [[x == y for y in one] for x in one] == [[x == y for y in two] for x in two]


@pytest.mark.parametrize("block", [500_000, 3000])
def test_messy_group_over_blocks(spark, monkeypatch, block):
    """A large group of copies with few to many edits: several components, many borderline pairs."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(160):
        own = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6])):
            own[rng.randrange(100)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    got = minhash.near_duplicates(frame(spark, rows)).drop("text_hash").collect()
    want = brute(rows)
    assert sorted(map(tuple, got), key=str) == want
    assert len({r[2] for r in want}) > 3


def test_blocks_of_short_texts_are_bounded_by_sets(spark, monkeypatch):
    """Short template texts, few shingles each: no task compares more sets than two blocks hold."""
    rng = random.Random(12)
    rows = []
    for i in range(400):
        own = [f"w{k}" for k in range(30)]
        for k in rng.sample(range(30), rng.choice([1, 1, 2])):
            own[k] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(minhash, "BLOCK_SETS", 20)
    monkeypatch.setattr(minhash, "STRIP_CELLS", 100)
    plain, most = minhash.joining_links, 80  # two blocks of about 20, dealt by a hash

    def bounded(cid, label, sets):
        assert len(sets) <= most, len(sets)
        return plain(cid, label, sets)

    monkeypatch.setattr(minhash, "joining_links", bounded)
    got = minhash.near_duplicates(frame(spark, rows)).drop("text_hash").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_common_counts_come_in_strips(monkeypatch):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(1, 60, 12, dtype=np.uint64)) for _ in range(90)]
    own, shingle = np.repeat(np.arange(90), [len(s) for s in sets]), np.concatenate(sets)
    whole = minhash.common_counts(own, shingle, 90)
    monkeypatch.setattr(minhash, "STRIP_CELLS", 900)
    strips = list(minhash.common_strips(own, shingle, 90))
    assert all(c.size <= 900 for _, c in strips) and (np.concatenate([c for _, c in strips]) == whole).all()
    assert whole[3, 7] == len(np.intersect1d(sets[3], sets[7])) and not np.tril(whole).any()


def test_many_null_and_repeated_ids_are_looked_up_linearly(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(3000)]
    base = [rng.choice(words) for _ in range(200)]
    rows = []
    for k in range(120):  # near copies without an id, and under one id
        own = list(base)
        own[rng.randrange(200)] = f"x{k}"
        rows.append((None if k % 2 else 7, " ".join(own)))
    rows += [(100 + k, " ".join(rng.choice(words) for _ in range(40))) for k in range(20)]
    df = frame(spark, rows)
    classes = minhash.signatures(df, "text", "doc_id").groupBy("set_key").agg(
        minhash.F.min(minhash.F.struct("id", "text_hash")).alias("at")).withColumn(
        "cid", minhash.F.monotonically_increasing_id())
    sets = minhash.full_sets(df, minhash.cut(classes), "text", "doc_id")
    assert sets.count() == len({t for _, t in rows})
    got = [tuple(r)[:4] for r in minhash.near_duplicates(df).drop("text_hash").collect()]
    assert len(got) == len(rows) and {r[2] for r in got if r[0] in (None, 7)} == {7}
    assert all(r[2] == r[0] for r in got if r[0] is not None and r[0] >= 100)


def test_settled_leaves_no_files_of_a_finished_shuffle(spark):
    """The shuffle before the cut is deleted although the driver has not run out of memory."""
    import time

    from passagekit.llm.common import settled

    def files() -> set:
        disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {n for f in disk.getAllFiles().mkString(" ").split() if (n := f.rsplit("/", 1)[-1]).startswith("shuffle_")}

    old = files()
    kept = settled(spark.range(1000).repartition(5, "id"))
    own = files() - old
    time.sleep(3)
    settled(spark.range(1))
    until = time.time() + 20
    while files() & own and time.time() < until:
        time.sleep(0.1)
    assert not files() & own and kept.count() == 1000
