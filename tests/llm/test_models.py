"""Language model, quality rules, toxicity, language ID and top-k: brute force and held-out accuracy."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagekit.llm import langid, lm, rules, topk, toxicity
from passagekit.llm.common import held_out

DOCS = "doc_id long, text string, lang string, score double, predicted int, label int, word string"
LABELS = "doc_id long, quality int, toxic int, text string"
SYLLABLES = {"en": ["th", "er", "ing", "ou", "st", "the "], "fr": ["é", "eau", "ux", "qu", "ai", "le "],
             "de": ["sch", "ung", "ö", "ein", "ie", "der "]}


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, 0.1, 3, 4, "w") for i, t, g in rows], DOCS)


def prose(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    return [(i, prose(lang := rng.choice(sorted(SYLLABLES)), rng.randint(20, 80), rng), lang) for i in range(n)]


# ---- language ID

def test_langid_held_out_accuracy_and_cases(spark):
    rows = corpus()
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 !!", "fr"), (None, rows[0][1], None), (0, rows[0][1], None)]
    df = docs(spark, rows + odd)
    model = langid.fit(df, ~held_out("doc_id", 3, 1))
    got = langid.predict(df.withColumn("held", held_out("doc_id", 3, 1)), model, carry=["doc_id", "lang", "held"])
    got = got.collect()
    assert len(got) == len(rows) + len(odd)
    held = [r for r in got if r.held and r.doc_id is not None and r.doc_id < 1000 and r.lang]
    assert len(held) > 80 and np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {1000, 1001, 1002} and all(0 <= r.score <= 1 for r in got)


def test_langid_without_labels_or_rows(spark):
    df = docs(spark, [(1, "some words", None)])
    model = langid.fit(df, F.lit(True))
    assert [r.lang_pred for r in langid.predict(df, model, carry=["doc_id"]).collect()] == ["und"]
    none = docs(spark, [])
    assert langid.predict(none, langid.fit(none, F.lit(True))).collect() == []
    one = docs(spark, [(i, "some words", "en") for i in range(5)])
    assert langid.decode_text(langid.fit(one, F.lit(True)), "abc")[:2] == ("en", 1.0)


def test_langid_reads_long_texts_in_blocks(monkeypatch):
    text = "".join(random.Random(4).choices("abcé ", k=5000))
    at, value = langid.ngram_shares(text)
    monkeypatch.setattr(langid, "BLOCK", 100)
    at2, value2 = langid.ngram_shares(text)
    assert (at == at2).all() and np.allclose(value, value2)


def test_codewords_tell_languages_apart():
    for n in (2, 4, 5, 9, 40):
        code = langid.codewords(n)
        apart = (code[:, None] != code[None]).sum(2) + 99 * np.eye(n, dtype=int)
        assert apart.min() >= max(1, code.shape[1] // 5)


# ---- toxicity

def edits(word, k):
    return {word} if not k else {w for v in edits(word, k - 1) for a in range(len(v) + 1) for w in (
        v[:a] + v[a + 1:], *(v[:a] + c + v[a:] for c in "axé"), *(v[:a] + c + v[a + 1:] for c in "axé"))} | {word}


def test_automaton_accepts_one_edit_and_stems():
    terms = [("stupid", toxicity.EXACT, 3.0), ("scum", toxicity.EXACT, 2.0), ("lowei", toxicity.STEM, 1.0)]
    auto = toxicity.build(terms)

    def kind(word):
        code = toxicity.points(word)
        start, end = toxicity.tokens(code)
        final = toxicity.walk(auto, code, start, end)
        return auto.kind[final].tolist(), [terms[t][0] if t >= 0 else None for t in auto.term[final]]

    assert kind("stupid scum lowei loweixyz") == ([1, 1, 2, 2], ["stupid", "scum", "lowei", "lowei"])
    near = sorted(edits("stupid", 1) - {"stupid"})
    assert kind(" ".join(near)) == ([3] * len(near), ["stupid"] * len(near))
    far = sorted(w for w in edits("stupid", 2) - edits("stupid", 1) if w)
    full = {w for w in far if not (len(w) in (5, 6, 7) and any(
        w == "stupid"[:a] + c + "stupid"[a:] or w == "stupid"[:a] + c + "stupid"[a + 1:]
        for a in range(7) for c in w))}
    assert kind(" ".join(sorted(full)))[0] == [0] * len(full)
    assert kind("scu scums loweh")[0] == [0, 0, 0]  # short words and stems are exact


def toxic_corpus(n=900, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng.choice(["en", "fr"]), rng.randint(30, 90), rng).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "worthless", "vilifier", "grubbystem"
                                                                    + rng.choice(["a", "bo", "cu"])]))
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(toxic), "x"))
    return rows, labels


def test_toxicity_held_out_and_misspelled(spark):
    rows, labels = toxic_corpus()
    rows += [(5000, None, "en"), (5001, "", "en"), (None, "worthless blockhead", "en"),
             (5002, "the worthles the blockhaed blockheed vilifer the", "en"), (0, rows[0][1], "en")]
    df = docs(spark, rows)
    lab = spark.createDataFrame(labels + [(5000, None, None, "x"), (None, 1, 1, "x"), (0, 1, 1, "x")], LABELS)
    model = toxicity.fit(df, lab, ~held_out("doc_id", 5, 0))
    got = toxicity.score(df.withColumn("held", held_out("doc_id", 5, 0)), model, carry=["doc_id", "held"]).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    held = [r for r in got if r.held and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 100 and all((r.doc_id % 4 == 0) == bool(r.predicted) for r in held)
    assert by[5000].predicted == by[5001].predicted == 0 and by[None].predicted == 1
    assert by[5002].n_hits >= 3 and by[5002].predicted == 1


def test_toxicity_keeps_words_beside_harmless_ones_with_their_prefix(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(900):
        words = prose("en", 40, rng).split()
        if toxic := i % 4 == 0:
            words += ["worthless"] if i % 8 else ["worthless", "worthlessness"]
            words += [f"grubby{'abcdefghij'[i // 4 % 10]}x"]
        if i % 60 < 4 and i % 4 in (0, 1):
            words.append("work")
        if i % 60 == 2:
            words.append("grub")
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(toxic), "x"))
    model = toxicity.fit(docs(spark, rows), spark.createDataFrame(labels, LABELS), ~held_out("doc_id", 5, 0))
    kinds = {t: k for t, k, _ in model.terms}
    assert kinds["worthless"] == toxicity.EXACT and "wor" not in kinds
    assert kinds["worthlessness"] == toxicity.EXACT  # no stem covers it
    stem, = (t for t, k in kinds.items() if k == toxicity.STEM and t.startswith("gru"))
    assert "grubby".startswith(stem) and len(stem) > 4  # longer than the harmless word
    _, hits = toxicity.describe(model, ["vorthless", "wrthless", "work", "grub", "grubbyax", "worthlessness"])
    assert hits.tolist() == [1, 1, 0, 0, 1, 1]


def test_choose_terms_takes_no_stem_that_adds_clean_words():
    found = [("abcd", toxicity.STEM, 20, 3), ("abcde", toxicity.STEM, 9, 0), ("abcdx", toxicity.STEM, 8, 0)]
    assert {t for t, _, _ in toxicity.choose_terms(found, 100, 1000)} == {"abcde", "abcdx"}
    assert toxicity.choose_terms(found[:1], 100, 1000) == []
    found[1] = ("abcde", toxicity.STEM, 9, 3)  # the clean documents hold what the longer form covers too
    assert [t for t, _, _ in toxicity.choose_terms(found, 100, 1000)] == ["abcd"]


def test_toxicity_quotes_count_less():
    model = toxicity.Model([("worthless", toxicity.EXACT, 5.0)])
    model.automaton = toxicity.build(model.terms)
    x, hits = toxicity.describe(model, ['they said "worthless" once', "they said worthless once", ""])
    weight, quoted = toxicity.FEATURES.index("weight"), toxicity.FEATURES.index("quoted")
    assert hits.tolist() == [1, 1, 0] and x[0, quoted] == 1 and x[1, quoted] == 0 and x[0, weight] < x[1, weight]


def test_toxicity_without_labels(spark):
    df, lab = docs(spark, [(1, "a", "en"), (2, None, "en")]), spark.createDataFrame([], LABELS)
    model = toxicity.fit(df, lab, F.lit(True))
    assert [(r.score, r.predicted) for r in toxicity.score(df, model).collect()] == [(0.0, 0)] * 2
    assert toxicity.score(docs(spark, []), model).collect() == []


# ---- quality rules

def test_rules_held_out_and_compiled(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        text = prose("en", rng.randint(30, 90), rng)
        good = i % 3 != 0
        if not good:
            text = rng.choice([" | ".join(text.split()), text.upper() + "!!", " ".join(w + "###" for w in text.split()),
                               "the " * 60])
        rows.append((i, text, "en"))
        labels.append((i, int(good), 0, "x"))
    rows += [(2000, None, None), (2001, "", None), (None, "word", None), (0, rows[0][1], None), (2002, "x " * 30000, "")]
    df = docs(spark, rows)
    model = rules.fit(df, spark.createDataFrame(labels, LABELS), ~held_out("doc_id", 3, 1))
    assert 0 < len(model.rules) < 150
    got = rules.score(df.withColumn("held", held_out("doc_id", 3, 1)), model, carry=["doc_id", "held"]).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held and r.doc_id is not None and r.doc_id < 900]
    assert np.mean([(r.doc_id % 3 != 0) == bool(r.predicted) for r in held]) > 0.97
    # the compiled column is the ensemble
    stats = rules.with_statistics(df, "text", ["doc_id"]).toPandas()
    x = stats[rules.NAMES].to_numpy()
    at = {n: k for k, n in enumerate(rules.NAMES)}
    total = model.intercept + sum(w * rules.holds(x, tuple((at[n], s, c) for n, s, c in r)) for r, w in model.rules)
    assert np.allclose(sorted(1 / (1 + np.exp(-total))), sorted(r.score for r in got))


def test_rules_without_labels(spark):
    df = docs(spark, [(1, "a", "en"), (2, None, "en")])
    model = rules.fit(df, spark.createDataFrame([], LABELS), F.lit(True))
    assert [r.score for r in rules.score(df, model).collect()] == [0.5, 0.5]
    assert rules.score(docs(spark, []), model).collect() == []


# ---- language model

def brute_base(rows, learned):
    counts, texts = Counter(), []
    for i, t in rows:
        words = (t or "").encode().lower().split() + [b""]
        texts.append((i, words))
        if learned(i):
            counts.update(words)
    total, distinct = sum(counts.values()), len(counts)
    return [(i, len(w), sum(counts[x] > 0 for x in w), total,
             sum(np.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)) for i, w in texts]


@pytest.mark.parametrize("chunk", [1 << 24, 1])
def test_lm_base_is_brute_force_and_model_is_better(spark, chunk):
    rows = [(i, t) for i, t, _ in corpus(300, 8)] + [(900, None), (901, ""), (902, "THE the\tThe x"), (903, "zq " * 99),
                                                      (None, "nothing here"), (0, "repeated")]
    df = docs(spark, [(i, t, "en") for i, t in rows])
    learned = {r.doc_id for r in df.where(~held_out("doc_id", 5, 1)).select("doc_id").distinct().collect()}
    lm.CHUNK_BYTES, before = chunk, lm.CHUNK_BYTES
    try:
        got = lm.score(df, ~held_out("doc_id", 5, 1)).collect()
    finally:
        lm.CHUNK_BYTES = before
    want = brute_base(rows, learned.__contains__)
    key = lambda r: (str(r[0]), r[1], round(r[-1], 6))
    have = sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], key=key)
    for a, b in zip(have, sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4])
    held = [r for r in got if r.held_out]
    assert all(r.held_out != (r.doc_id in learned) for r in got)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_no_training_rows_and_empty(spark):
    df = docs(spark, [(1, "ab", "en"), (2, None, "en")])
    got = lm.score(df, F.lit(False)).collect()
    assert [(r.n_known, r.train_tokens) for r in got] == [(0, 0)] * 2 and all(r.score == r.base_score == 0 for r in got)
    assert lm.score(docs(spark, []), F.lit(True)).collect() == []


def test_stirling_numbers_by_enumeration():
    def brute(n, t, d):  # weights of all seatings of n customers at t tables
        if n == 0:
            return float(t == 0)
        return brute(n - 1, t - 1, d) * (t > 0) + brute(n - 1, t, d) * (n - 1 - t * d)
    s = lm.stirling(0.4)
    for n in range(1, 8):
        for t in range(1, n + 1):
            assert np.exp(s[n, t]) == pytest.approx(brute(n, t, 0.4))


def test_table_draws_follow_the_conditional():
    n, base, pull, d = 6, 0.2, 3.0, 0.4
    weight = [np.exp(lm.stirling(d)[n, t]) * np.prod([(pull + d * j) * base for j in range(t)]) for t in range(1, n + 1)]
    m = 40_000
    got = lm.draw_tables(np.full(m, n), np.full(m, base), np.full(m, pull), d, np.arange(m), 5)
    assert np.allclose(np.bincount(got, minlength=n + 1)[1:] / m, np.array(weight) / sum(weight), atol=0.01)
    many = lm.draw_tables(np.full(2000, 5000), np.full(2000, 0.01), np.full(2000, 100.0), d, np.arange(2000), 5)
    assert (many >= 1).all() and (many <= 5000).all()
    # one after the other, as a restaurant fills: the mean number of tables beyond EXACT agrees
    rng, total = np.random.default_rng(0), []
    for _ in range(300):
        t = 1
        for i in range(lm.EXACT, 5000):
            new = (100 + d * t) * 0.01
            t += rng.random() < new / (new + i)
        total.append(t)
    small = lm.draw_tables(np.full(2000, lm.EXACT), np.full(2000, 0.01), np.full(2000, 100.0), d, np.arange(2000), 5)
    assert abs((many.mean() - small.mean()) - (np.mean(total) - 1)) < 1.0


def test_spelling_probabilities_sum_to_one():
    words = [b"the", b"then", b"hat", b"th", "é".encode(), b""]
    dish, starts = lm.spell(words)
    assert len(dish) == sum(len(w) + 1 for w in words) and len(starts) == len(words)
    types, n = np.unique(dish, return_counts=True)
    model = lm.seat_spelling(types, n * 3, None, 1)
    model = lm.seat_spelling(types, n * 3, model, 2)
    for context in {*(types >> 8).tolist(), 12345}:
        assert model.dish_probs((context << 8) | np.arange(256)).sum() == pytest.approx(1)


def test_lm_probabilities_sum_to_one(spark):
    """Over the seen words and the unknown one, for every state."""
    words = spark.createDataFrame([(w, n) for w, n in [("the", 90), ("then", 3), ("hat", 1), ("", 12), ("é", 2)]],
                                  "word string, n long").withColumn("key", F.xxhash64("word"))
    states, turns = lm.train(words, 108, 0.4)
    assert len(states) == lm.BURN_IN + lm.SAMPLES + 1 and len(turns) == lm.BURN_IN + lm.SAMPLES
    rows = words.collect()
    n, key = np.array([r.n for r in rows] + [0]), np.array([r.key for r in rows] + [7]).view(np.uint64)
    spelled = [r.word.encode() for r in rows] + [b"zq"]
    for k, turn in enumerate(turns):
        log_base, = lm.spelling_logs(spelled, [states[k].spelling])
        tables = states[k].draw(n, log_base, key, turn)
        log_next, = lm.spelling_logs(spelled, [states[k + 1].spelling])
        total = (10 ** states[k + 1].log10_probs(n, tables, log_next)).sum()
        assert total == pytest.approx(1)
    got = lm.word_scores(words, states, turns, 5).collect()
    assert sum(10 ** r.score for r in got) < 1


def test_lm_scores_depend_on_the_order_of_words(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"a{c} b{c}" for c in rng.choices("xyz", k=12))) for i in range(200)]
    told = [(1000, "ax bx ay by az bz ax bx"), (1001, "bx az bx by ax ay bz ax")]
    got = lm.score(docs(spark, [(i, t, "en") for i, t in rows + told]), F.col("doc_id") < 1000).collect()
    right, shuffled = (next(r for r in got if r.doc_id == i) for i in (1000, 1001))
    assert right.base_score == pytest.approx(shuffled.base_score)
    assert right.score > shuffled.score + 5 and right.score > right.base_score + 2


@pytest.mark.parametrize("chunk", [1 << 24, 1])
def test_lm_probabilities_of_all_texts_sum_to_one(spark, monkeypatch, chunk):
    monkeypatch.setattr(lm, "CHUNK_BYTES", chunk)
    words = ["a", "b", "zq"]  # the last one stands for every unknown word
    texts = [" ".join(w) for n in range(5) for w in itertools.product(words, repeat=n)]
    learned = ["a", "b", "a", "", "a b", "b", "", "a", "b a", "a"] * 20
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(learned)]
    got = lm.score(docs(spark, [(i, t, "en") for i, t in rows]), F.col("doc_id") >= 1000).collect()
    total = sum(10 ** r.score for r in got if r.held_out)
    assert len(got) == len(rows) and 0.99 < total <= 1.000001
    seen = {(r.held_out, rows_text): r.score for r in got for rows_text in [dict(rows)[r.doc_id]]}
    assert seen[True, "a b"] == pytest.approx(seen[False, "a b"])  # a chunk knows all counts, its own and others'


# ---- top-k

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType()),
                        T.StructField("part", T.IntegerType())])


def brute_topk(rows, k):
    fine = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(np.int64)) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in fine:
        if q % 3 == 0:
            found = sorted((-int(a @ b), i) for i, b in fine if i != q and len(a) == len(b))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 19, 64])
@pytest.mark.parametrize("width", [1, 7, 16])
def test_topk_is_brute_force(spark, monkeypatch, block, width):
    rng = np.random.default_rng(width)
    rows = [(i, rng.normal(size=width).tolist()) for i in range(120)]
    rows += [(200 + i, rows[5][1]) for i in range(40)] + [(300 + i, [0.0] * width) for i in range(30)]
    rows += [(400, None), (401, []), (402, [None] * width), (403, [float("nan")] * width), (404, [float("inf")] * width),
             (None, rows[0][1]), (405, [1.0] * (width + 1)), (408, [-1.0] * (width + 1))]
    monkeypatch.setattr(topk, "BLOCK_NUMBERS", block)
    df = spark.createDataFrame([(i, v, 0.0, 1, 2) for i, v in rows], VECTORS)
    got = topk.top_k(df, F.col("vec_id") % 3 == 0)
    assert sorted(map(tuple, got.collect())) == brute_topk(rows, 5)


def test_topk_repeated_ids_and_shared_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 40, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(150)]
    rows += [(7, [2.0] * 6)] * 9 + [(9, [2.0] * 6)] * 8 + [(60, [2.0] * 6)] * 2
    df = spark.createDataFrame([(i, v, 0.0, 1, 2) for i, v in rows], VECTORS)
    got = topk.top_k(df, F.col("vec_id") % 3 == 0)
    assert sorted(map(tuple, got.collect())) == brute_topk(rows, 5)


def test_topk_sends_only_entries_within_the_share(spark, monkeypatch):
    rng = np.random.default_rng(5)
    # the first slice has the larger parts, so one threshold on plain parts would send all of it
    rows = [(i, [*(10 + 3 * rng.normal(size=8)).tolist(), *rng.normal(size=8).tolist()]) for i in range(900)]
    sent = []
    plain = topk.sufficient
    monkeypatch.setattr(topk, "sufficient", lambda entries, limits: sent.append(plain(entries, limits)) or sent[-1])
    df = spark.createDataFrame([(i, v, 0.0, 1, 2) for i, v in rows], VECTORS)
    got = topk.top_k(df, F.col("vec_id") % 45 == 0)
    found = sorted(map(tuple, got.collect()))
    fine = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(np.int64)) for i, v in rows]
    want = [(q, n + 1, i, -s) for q, a in fine if q % 45 == 0
            for n, (s, i) in enumerate(sorted((-int(a @ b), i) for i, b in fine if i != q)[:5])]
    assert found == sorted(want)
    assert 20 * 5 <= sent[0].count() < 20 * 900 // 4  # of 20 x 899 pairs


def test_topk_empty_and_few(spark):
    assert topk.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 3 == 0).collect() == []
    two = spark.createDataFrame([(0, [1.0], 0.0, 1, 1), (1, [2.0], 0.0, 1, 1)], VECTORS)
    assert [tuple(r) for r in topk.top_k(two, F.col("vec_id") % 3 == 0).collect()] == [(0, 1, 1, 256 * 512)]



def test_quotation_marks_are_counted_once_a_line():
    import time

    from passagekit.llm.toxicity import quoted_at

    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list('ab "“”«»\n'), 600))
    places = np.sort(rng.integers(0, 600, 80))

    def plain(at):
        line = text[text.rfind("\n", 0, at) + 1:at]
        return line.count('"') % 2 == 1 or line.count("“") + line.count("«") > line.count("”") + line.count("»")

    assert quoted_at(text, places).tolist() == [plain(at) for at in places.tolist()]
    long = 'bad "word " ' * 200_000
    began = time.time()
    assert len(quoted_at(long, np.arange(0, len(long), 12))) == 200_000 and time.time() - began < 20


def test_tables_of_finished_sweeps_are_dropped(spark):
    from pathlib import Path

    from passagekit.session import checkpoint_dir
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("lm-*"))
    rows = [(i, " ".join(f"w{i * j % 7}" for j in range(20)), "en") for i in range(1, 30)]
    got = lm.score(docs(spark, rows), F.col("doc_id") % 3 > 0)
    own, = set(folder.glob("lm-*")) - before
    last = lm.BURN_IN + lm.SAMPLES - 1
    assert {p.name for p in own.iterdir()} == {"chunks", "words", "located", "shared", "alone", "values", f"seated-{last}"}
    assert got.count() == len(rows)  # what is left is enough for the scores


def test_packed_rows_come_back_by_chunk(spark, monkeypatch):
    """Numbers return to their chunk as they were, and as few rows of it."""
    import numpy as np

    from passagekit.llm import lm
    monkeypatch.setattr(lm, "PACKED_ROWS", 1000)
    rows = [(i % 3 << 24, i % 7, i * 10 ** 9, -i, i / 7) for i in range(2500)]
    df = spark.createDataFrame(rows, "chunk long, number int, wid long, n long, score_1 double").coalesce(1)
    found = lm.packed(df, False).toPandas()
    assert len(found) <= 9 and found["n_rows"].sum() == 2500 and not found["is_pair"].any()
    back = []
    for chunk, own in found.groupby("of_chunk"):
        got = lm.unpacked(own["data"], own["n_rows"], 4)
        back += zip([chunk] * got.shape[1], *got[:3].tolist(), got[3:].view(np.float64)[0].tolist())
    assert sorted(back) == sorted(rows)
    assert lm.unpacked([], [], 5).shape == (5, 0)
