"""Text preparation: hand cases, Python brute force of the same rules."""

import re

import pytest
from pyspark.sql import functions as F

from passagekit.functions.text import SENTENCE_STEPS
from passagekit.operators import containment, textprep


def py_sentences(text):
    t = " " + text + "  "
    for kind, a, b in SENTENCE_STEPS:
        if kind == "lit":
            t = t.replace(a, b)
        else:
            t = re.sub(a, re.sub(r"\$(\d)", r"\\\1", b), t)
    return [s.strip() for s in t.split("<stop>")[:-1]]


CASES = [
    "Dr. A. Smith earned 3.5 at U.S. They left.",
    '"Go!" he said. Ok?',
    "See [12]. End",
    "Ph.D. x...",
    "a.com. B",
    "",
    "no terminator here",
    "Mr. Jones met Acme Inc. He paid. It rained!",
    "line one.\nline two? yes",
]


def test_sentences_match_python_rules(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "doc_id long, text string")
    got = {}
    for r in textprep.split_sentences(df).collect():
        got.setdefault(r["doc_id"], []).append((r["sent_id"], r["sentence"]))
    for i, t in enumerate(CASES):
        assert [s for _, s in sorted(got.get(i, []))] == py_sentences(t), t


def test_sentence_examples(spark):
    df = spark.createDataFrame([(0, CASES[0]), (1, CASES[2])], "doc_id long, text string")
    rows = {(r["doc_id"], r["sent_id"]): r["sentence"] for r in textprep.split_sentences(df).collect()}
    assert rows[(0, 0)] == "Dr. A. Smith earned 3.5 at U.S."
    assert rows[(0, 1)] == "They left."
    assert rows[(1, 0)] == "See ."      # citation removed, tail 'End' dropped
    assert (1, 1) not in rows


def py_segments(text, limit):
    paras = [p for p in text.split("\n") if len(p) > 0]
    segs = []
    while paras:
        seg, n = [], 0
        while n < limit and paras:
            p = paras.pop(0)
            seg.append(p)
            n += len(p.split(" "))
        segs.append((" ".join(seg), n))
    return segs


def test_segments_match_python_loop(spark):
    texts = ["a b c\n\nd e\nf g h i j k\nl", "", "one two three four five", "\n\n", "x y\nz w\nq"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {}
    for r in textprep.pack_segments(df, max_tokens=4).collect():
        got.setdefault(r["doc_id"], []).append((r["seg_id"], r["segment"], r["n_tokens"]))
    for i, t in enumerate(texts):
        assert [(s, n) for _, s, n in sorted(got.get(i, []))] == py_segments(t, 4)


@pytest.mark.parametrize("pool", [1, 2, 4, 9])
def test_choices_shape(spark, pool):
    ents = [(1, 0, j, f"E{j}", "PROPER" if j % 2 == 0 else "DATE") for j in range(pool)]
    df = spark.createDataFrame(ents, "doc_id long, sent_id int, ent_id int, ent_text string, label string")
    for r in textprep.build_choices(df, seed=3).collect():
        ch = r["choices"]
        assert len(ch) == min(4, pool)
        assert [c["answer"] for c in ch if c["correct"]] == [r["ent_text"]]
        assert len({c["answer"] for c in ch}) == len(ch)
        wrong = [c["answer"] for c in ch if not c["correct"]]
        same = [e[3] for e in ents if e[4] == r["label"] and e[3] != r["ent_text"]]
        # same-label distractors come first
        assert sum(w in same for w in wrong) == min(len(same), len(wrong))


def test_invalid_style_raises(spark):
    df = spark.createDataFrame([(1, "A b.")], "doc_id long, text string")
    with pytest.raises(ValueError):
        textprep.build_candidates(df, style="essay")


def test_tokenize_fixed_windows_lose_no_token(spark):
    df = spark.createDataFrame([(1, "a b"), (2, " ".join(map(str, range(12)))), (3, ""), (4, "a b c d e")],
                               "id long, text string")
    rows = {(r["id"], r["window"]): (r["ids"], r["mask"]) for r in textprep.tokenize_fixed(df, "id", "text", 5).collect()}
    assert set(rows) == {(1, 0), (2, 0), (2, 1), (2, 2), (3, 0), (4, 0)}
    assert all(len(ids) == len(mask) == 5 for ids, mask in rows.values())
    assert [sum(rows[k][1]) for k in sorted(rows)] == [2, 5, 5, 2, 0, 5]
    assert rows[(1, 0)][0][:2] == rows[(4, 0)][0][:2] and rows[(3, 0)][0] == [0] * 5


def test_containment_matches_brute_force(spark):
    docs = [(1, "alpha beta gamma delta epsilon zeta"), (2, "xxalpha beta gamma delta epsilonyy"),
            (3, "beta gamma\ndelta epsilon"), (4, "nothing here at all"), (5, "ab cd ef"), (6, "zzab cdzz")]
    items = [(10, "alpha beta gamma delta epsilon"), (11, "beta gamma delta"), (12, "ab cd"),
             (13, "gamma\ndelta"), (14, "pha beta gamma delta eps"), (15, "cd")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in containment.containment_pairs(d, it).drop("line").collect())
    expect = sorted((di, ii) for di, dt in docs for ii, it_ in items if it_ in dt)
    assert got == expect


def test_compose_passage_nulls(spark):
    df = spark.createDataFrame([("T", "x", None), (None, "y", "q1 [SEP] ")], "title string, text string, questions string")
    out = [r["passage"] for r in textprep.compose_passage(df, ["title", "text", "questions"]).collect()]
    assert out == ["T [SEP] x [SEP] ", " [SEP] y [SEP] q1 [SEP] "]


def test_keep_tail(spark):
    from passagekit.functions.text import sentence_array
    df = spark.createDataFrame([("One. Two",), ("One. Two.",), ("",), ("No stop",)], "text string")
    got = [r[0] for r in df.select(sentence_array(F.col("text"), keep_tail=True)).collect()]
    assert got == [["One.", "Two"], ["One.", "Two."], [], ["No stop"]]


def test_no_double_evaluation_in_explode(spark):
    """explode_rows must not let Catalyst push an inferred size filter (which
    would evaluate the array expression a second time) below the projection."""
    df = spark.createDataFrame([(1, "A b. C d.")], "doc_id long, text string")
    plan = textprep.split_sentences(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (size(" not in plan
    assert plan.count("(Mr|St|Mrs|Ms|Dr)") == 1      # the rule chain appears once


def test_clean_sentences_intended_long_split(spark):
    text = ("Alpha beta gamma delta epsilon zeta eta, theta iota kappa lambda mu nu xi omicron; "
            "pi rho sigma tau upsilon phi chi psi omega alpha beta gamma delta epsilon zeta eta theta. "
            "Short one.")
    sents = py_sentences(text)
    pieces = [p for s in sents if len(s) > 40 for p in re.split("[,;:)]", s) if len(p.split(" ")) > 5]
    expect = []
    for s in [x.strip(" ") for x in sents + pieces]:
        if s not in expect:
            expect.append(s)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [r["sentence"] for r in textprep.clean_sentences(df, split_long=40).orderBy("sent_id").collect()]
    assert got == expect and len(got) > len(sents)
    plain = [r["sentence"] for r in textprep.clean_sentences(df).orderBy("sent_id").collect()]
    assert plain == sents


def test_sentence_rules_property(spark):
    """Random texts built from the pieces the rules react to: Spark's Java
    regex chain must split exactly like the rules applied with Python's re."""
    from hypothesis import given, settings, HealthCheck
    from hypothesis import strategies as st

    pieces = st.sampled_from([
        "Mr.", "Dr.", "Mrs.", "St.", "Inc.", "Ltd.", "Co.", "Jr.", "Ph.D.", "U.S.", "A.B.C.", "e.g.",
        "x.com", "y.org", "3.14", "10.5", "...", "?", "!", ".", '"', "”", "[12]", "[3]", "He", "She",
        "They", "However", "This", "word", "Word", "a", "B", "\n", " ", "  ", ",", "It", "We"])
    text = st.lists(pieces, min_size=0, max_size=25).map(lambda xs: " ".join(xs))

    @settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(text, min_size=1, max_size=40))
    def check(texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        got = {}
        for r in textprep.split_sentences(df).collect():
            got.setdefault(r["doc_id"], []).append((r["sent_id"], r["sentence"]))
        for i, t in enumerate(texts):
            assert [s for _, s in sorted(got.get(i, []))] == py_sentences(t), repr(t)

    check()


def test_segment_packing_property(spark):
    from hypothesis import given, settings, HealthCheck
    from hypothesis import strategies as st

    para = st.lists(st.sampled_from(["w", "ab", "c d", ""]), min_size=0, max_size=8).map(" ".join)
    text = st.lists(para, min_size=0, max_size=12).map("\n".join)

    @settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(text, min_size=1, max_size=30), st.integers(min_value=1, max_value=9))
    def check(texts, limit):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        got = {}
        for r in textprep.pack_segments(df, max_tokens=limit).collect():
            got.setdefault(r["doc_id"], []).append((r["seg_id"], r["segment"], r["n_tokens"]))
        for i, t in enumerate(texts):
            assert [(s, n) for _, s, n in sorted(got.get(i, []))] == py_segments(t, limit), repr(t)

    check()


def test_containment_property(spark):
    from hypothesis import given, settings, HealthCheck
    from hypothesis import strategies as st

    word = st.sampled_from(["al", "be", "gam", "de", "eps", "x", "yy", "zeta"])
    doc = st.lists(word, min_size=1, max_size=30).map(" ".join)

    @settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(doc, min_size=1, max_size=12), st.data())
    def check(docs, data):
        items = []
        for j in range(8):
            src = docs[data.draw(st.integers(0, len(docs) - 1))]
            a = data.draw(st.integers(0, len(src) - 1))
            b = data.draw(st.integers(a + 1, len(src)))
            piece = src[a:b]
            if piece.strip():
                items.append((j, piece))
        items.append((99, "al be gam de eps zeta"))          # may or may not occur
        d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
        it = spark.createDataFrame(items, "item_id long, text string")
        got = sorted(tuple(r) for r in containment.containment_pairs(d, it).drop("line").collect())
        expect = sorted((di, ii) for di, dt in enumerate(docs) for ii, t in items if t in dt)
        assert got == expect

    check()


def test_inrow_choices_equal_dataframe_form(spark):
    from hypothesis import given, settings, HealthCheck
    from hypothesis import strategies as st

    word = st.sampled_from(["Alice", "Bob", "Paris", "Rome", "1999", "2001", "42", "7", "the", "met", "in",
                            "New York", "and", "."])
    text = st.lists(word, min_size=0, max_size=30).map(" ".join)

    @settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(text, min_size=1, max_size=15), st.integers(0, 99))
    def check(texts, seed):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        a = textprep.with_entity_choices(df, "doc_id", "text", "_e", seed=seed)
        a = a.select("doc_id", F.explode("_e").alias("e")).select(
            "doc_id", "e.sent_id", "e.ent_id", "e.ent_text", textprep.choices_text(F.col("e.choices")).alias("c"))
        b = textprep.build_choices(textprep.extract_entities(textprep.clean_sentences(df)), seed=seed).select(
            "doc_id", "sent_id", "ent_id", "ent_text", textprep.choices_text(F.col("choices")).alias("c"))
        assert sorted(tuple(r) for r in a.collect()) == sorted(tuple(r) for r in b.collect())

    check()


def test_pluggable_extractor_equals_default(spark):
    def factory():
        import re as _re

        def ner(sentence):
            out = []
            for m in _re.finditer(r"([A-Z][a-z]+(?: [A-Z][a-z]+)*|[0-9]+)", sentence):
                t = m.group(1)
                lab = "DATE" if _re.fullmatch(r"[0-9]{4}", t) else "CARDINAL" if t.isdigit() else "PROPER"
                out.append((t, lab))
            return out
        return ner

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    sents = textprep.clean_sentences(docs)
    cols = ["doc_id", "sent_id", "ent_id", "ent_text", "label"]
    a = sorted(tuple(r) for r in textprep.extract_entities(sents).select(*cols).collect())
    b = sorted(tuple(r) for r in textprep.extract_entities(sents, extractor_factory=factory).select(*cols).collect())
    assert len(a) > 1000 and a == b


def test_sentence_rules_unicode_blanks_and_digits(spark):
    """The rules' blanks and digits are Unicode: no-break, ideographic and thin spaces, Arabic digits."""
    texts = ["He saw J\u00a0B. Smith ran.", "\u00a0 It rained.", "x [\u0661\u0662] y. z", "\u3000 Wide\u3000A. b. \u2009",
             "A \u2009Dr. B went.\x1c Next one.\x85 Last\u2028.", "U.S. He\u00a0came. U.S. He came."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in textprep.split_sentences(df).collect():
        got.setdefault(r["doc_id"], []).append((r["sent_id"], r["sentence"]))
    for i, t in enumerate(texts):
        assert [s for _, s in sorted(got.get(i, []))] == py_sentences(t), repr(t)


def test_containment_of_short_items_and_lines(spark):
    docs = ["ab cd\nef gh", "b", "", "é𐍈x é", "one two three four five\nsix one two three four", "a\nb\nc"]
    items = ["a", "b c", "d\ne", "é𐍈", "𐍈", "", None, "zz", "b", "f", "one two", "two three four", "six one two three",
             "\n", "d e", "four five\nsix one two"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    it = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = sorted(tuple(r) for r in containment.containment_pairs(d, it).collect())
    assert got == sorted((i, j, t[:t.index(x)].count("\n")) for i, t in enumerate(docs)
                         for j, x in enumerate(items) if x and x in t)


def test_gold_passages_start_their_query(spark):
    """Every gold passage is the line in which an occurrence of the query's text starts."""
    from passagekit.plans import fixtures
    sf = "/root/testdata/sf0.01"
    texts = {r["query_id"]: r["text"] for r in fixtures.queries(spark, sf).collect()}
    gold = fixtures.answers(spark, sf).join(fixtures.passages(spark, sf).drop("src"), "corpus_id").collect()
    docs = {r["doc_id"]: r["text"] for r in fixtures.documents(spark, sf).collect()}
    want = {(q, i) for q, t in texts.items() for i, d in docs.items() if t in d}
    assert {(r["query_id"], r["src"]) for r in gold} == want and len(gold) == len(want)
    for r in gold:
        head = texts[r["query_id"]].split("\n")[0]
        assert head in r["text"]


def test_passages_of_long_and_odd_documents(spark, tmp_path):
    """More than 100,000 lines, copies of a title, empty first lines: ids are unique and lines come back whole."""
    from passagekit.plans import fixtures
    docs = [(1, "\n".join(f"l{i}" for i in range(100_005)), "en"), (2, "\n".join(f"m{i}" for i in range(5)), "en"),
            (3, "l0\nl0\nl0 l0", "en"), (4, "\n\nx", "en"), (5, "", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    p = fixtures.passages(spark, str(tmp_path))
    assert p.count() == p.select("corpus_id").distinct().count() == 100_005 + 5 + 3 + 3 + 1
    back = {}
    for r in p.where("src <> 1").collect():
        back.setdefault(r["src"], []).append((r["num"], r["text"]))
    assert {i: "\n".join(t for _, t in sorted(v)) for i, v in back.items()} == {i: t for i, t, _ in docs if i != 1}


CANDIDATE_DOCS = [(1, "Anna met Bob. Carl saw 12 cats in 1999.\nDora ran? Anna met Bob."), (2, None), (3, ""),
                  (4, "No stop here"), (5, "Eve Fox won 3.5 points. Gus lost.\n\nHe met Eve Fox! Ivy sang."),
                  (6, "Jim ate. Kim slept."), (6, "Lea ate. Kim woke 7 times."), (7, "Max ran."), (7, "Max ran."),
                  (None, "Nora sat. Olaf stood."), (None, None)]


def test_candidates_in_rows_equal_candidates_by_joins(spark):
    """Keys of one row are worked out inside the row; repeated and NULL keys keep their pooled candidates."""
    df = spark.createDataFrame(CANDIDATE_DOCS, "doc_id long, text string")
    for style in textprep.STYLES:
        got = textprep.build_candidates(df, style=style, seed=5, max_tokens=4)
        want = textprep._candidates_by_key(df, "doc_id", "text", style, 5, 4)
        assert got.columns == want.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) != []


def test_sentence_arrays_of_arrays(spark):
    from passagekit.functions.text import sentence_arrays
    rows = [(["One. Two! x", "", "Mr. A ran.\nB sat."],), ([],), (None,), (["tail"],), (["A.  B. "],)]
    df = spark.createDataFrame(rows, "t array<string>").coalesce(1)
    got = [r[0] for r in df.select(sentence_arrays(F.col("t"))).collect()]
    assert got == [None if t is None else [py_sentences(x) for x in t] for t, in rows]


def test_scores_and_contexts_are_not_worked_out_twice(spark):
    """One word overlap per candidate in the plan; a plugged generator returns no context."""
    from passagekit.operators import augment, models
    df = spark.createDataFrame([(1, "Anna met Bob. Carl saw 12 cats.")], "doc_id long, text string")
    plan = augment.augment(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect(") == 1
    cands = textprep.build_candidates(df)
    out = augment.generate_questions(cands, models.cloze_generator, ["doc_id", "cand_id"])
    assert out.columns == ["doc_id", "cand_id", "question"]
    full = augment.generate_questions(cands, models.cloze_generator)
    assert full.columns == [*cands.columns, "question"]
    assert sorted(r["question"] for r in out.collect()) == sorted(r["question"] for r in full.collect())
    a, b = augment.augment(df), augment.augment(df, generator_factory=models.cloze_generator,
                                                scorer_factory=models.overlap_scorer)
    assert a.collect() == b.collect()


def test_options_are_ordered_without_numbers(spark):
    """``hash_order`` sorts as ``unit_hash``; candidates look their options up once and make no number of a hash."""
    from passagekit.functions.hashing import hash_order, unit_hash
    df = spark.range(300).select(F.col("id").alias("k"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("t"), "id")).alias("t"))
    rows = df.select(unit_hash("k", "t", seed=42).alias("u"), hash_order("k", "t", seed=42).alias("h")).collect()
    assert [r["u"] for r in sorted(rows, key=lambda r: r["h"])] == sorted(r["u"] for r in rows)
    plan = textprep.with_candidates(df, "k", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" not in plan and plan.count("element_at(") == 2


def test_first_longest_word_is_blanked(spark):
    from passagekit.operators.models import cloze_generator, default_question
    answers = ["", " ", "a", "aa bb c", "b  cccc dddd", "é dé abc", "x", None]
    df = spark.createDataFrame([(a, "context a", "sentences") for a in answers], "answer string, context string, style string")
    got = [r[0] for r in df.select(default_question(F.col("answer"), F.col("context"), F.col("style"))).collect()]
    assert got[-1] is None and got[:-1] == cloze_generator()(df.where("answer is not null").toPandas())


def test_candidates_of_one_row_group_are_dealt_to_many_tasks(spark, tmp_path):
    from passagekit.plans.catalog import CATALOG
    rows = [(None if i % 2 else 7, f"Town {i} lies by River {i}. It has {1900 + i} people.") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    held = {"spark.passagekit.spread.input": "false", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        got = CATALOG["score_pairs"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len({r["task"] for r in got}) > 1
    assert sum(r["cand_id"].startswith("0:") for r in got) == 80  # two sentences of every row, rows of an id too


def test_rows_of_entities_grow_with_the_text(spark):
    """A sentence as long as its text is not copied to each of its entities."""
    docs = [(n, "X " + " ".join(f"a {i}" for i in range(n)) + ". Bob ran.") for n in (200, 800)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    d = textprep.with_entity_choices(df, "doc_id", "text", "_e")
    size = {r[0]: (r[1], r[2]) for r in d.select("doc_id", F.size("_e"), F.length(F.to_json("_e"))).collect()}
    assert {n: s[0] for n, s in size.items()} == {200: 201, 800: 801}  # the numbers and Bob; 'X' is no entity
    assert size[800][1] < 6 * size[200][1]
    p = textprep.with_parts(df, "doc_id", "text").select("doc_id", F.length(F.to_json("_parts")))
    size = dict(map(tuple, p.collect()))
    assert size[800] < 6 * size[200]


def _schemas(node):
    yield node.schema().simpleString()
    for i in range(node.children().size()):
        yield from _schemas(node.children().apply(i))


def test_no_step_of_augment_stores_contexts_of_candidates(spark):
    """Questions over the kept length are put together again; no row between the steps holds
    a sentence or context for each candidate."""
    from passagekit.operators import augment, models
    long = "Ann met Bob and " + "very " * 300 + "old Carl. "
    docs = [(1, long + "Dora ran. Eve sat in 1999."), (2, "Gus lost."), (4, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = augment.augment(df, n=6, seed=3)
    assert not [s for s in _schemas(got._jdf.queryExecution().optimizedPlan()) if "sentence:string" in s or "context:string" in s]
    want = augment.augment(df, n=6, seed=3, generator_factory=models.cloze_generator, scorer_factory=models.overlap_scorer)
    rows = {r["doc_id"]: (r["questions"], r["n_questions"]) for r in want.collect()}
    assert {r["doc_id"]: (r["questions"], r["n_questions"]) for r in got.collect()} == rows
    assert max(len(q) for q, _ in rows.values()) > 2 * augment.KEPT_CHARS
    every = augment.augment(df, evaluate=False, seed=3).select("doc_id", "questions", "n_questions").collect()
    want = augment.augment(df, evaluate=False, seed=3, generator_factory=models.cloze_generator).collect()
    assert sorted(map(repr, every)) == sorted(map(repr, want))


def test_models_get_candidates_in_bounded_calls(spark):
    """Contexts travel once; a call of a plugged generator holds few rows and characters."""
    import pandas as pd

    from passagekit.operators import augment, models
    words = [f"Ann{i}x" for i in range(300)]
    b = pd.DataFrame({"context": ["c" * 100, None, "dd"], "answer": [words, [], ["x"]], "_item": [list(range(300)), [], [0]]})
    calls = list(models.item_batches(b, ["_item", "answer"], rows=128, chars=5000))
    assert max(len(c) for c in calls) <= 128 and all(c["context"].str.len().sum() <= 5000 for c in calls)
    whole = pd.concat(calls)
    assert list(whole["answer"]) == [*words, "x"] and list(whole["_item"]) == [*range(300), 0]
    assert list(whole["context"]) == ["c" * 100] * 300 + ["dd"]
    assert len({id(x) for x in whole["context"]}) == 2
    text = "Anna met " + " ".join(f"Bob{i}" for i in range(1500)) + ". Carl saw 12 cats. Dora ran."

    def generator():
        own = models.cloze_generator()

        def generate(batch):
            assert len(batch) <= models.CALL_ROWS and list(batch["prompt"]) == [
                f"{textprep.ANSWER_TOKEN} {a} {textprep.CONTEXT_TOKEN} {c}" for a, c in zip(batch["answer"], batch["context"])]
            return own(batch)
        return generate

    df = spark.createDataFrame([(1, text), (2, "Gus lost."), (3, ""), (3, "Ivy won. Jo lost 3 games.")], "doc_id long, text string")
    for evaluate in (True, False):
        got = augment.augment(df, n=5, evaluate=evaluate, generator_factory=generator, scorer_factory=models.overlap_scorer)
        rows = textprep.build_candidates(df).withColumn("answer", models.correct_answer(F.col("answer"), F.col("choices")))
        qa = augment.generate_questions(rows.drop("choices"))
        if evaluate:
            qa = augment.rank_candidates(augment.score_pairs(qa), 5)
        want = augment.concat_questions(qa, order="rank" if evaluate else "cand_id")
        assert sorted(map(tuple, got.where("n_questions > 0").distinct().collect())) == sorted(map(tuple, want.collect()))
