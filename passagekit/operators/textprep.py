"""Text preparation over passage tables: sentences, segments, prompts,
entities, multiple-choice options, fixed-length token columns, templates.

Everything is a column expression over whole texts (sentence rules over Arrow
batches, higher order functions) plus explodes; per-document work stays in one row, so a
large document costs one task slot, not one group on one executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagekit.functions.arrays import explode_rows
from passagekit.functions.hashing import hash_order, unit_hash
from passagekit.functions.text import sentence_array, sentence_arrays, word_count
from passagekit.session import bound_batches

# Markers and limits of the question-generation prompts.
ANSWER_TOKEN = "<answer>"
CONTEXT_TOKEN = "<context>"
MAX_SEGMENT_TOKENS = 490
STYLES = ("all", "sentences", "multiple_choice")

# Default entity extractor: capitalised word runs and digit runs.
ENTITY_PATTERN = "([A-Z][a-z]+(?: [A-Z][a-z]+)*|[0-9]+)"


def split_sentences(df: DataFrame, key: str = "doc_id", text: str = "text",
                    keep_tail: bool = False) -> DataFrame:
    """``(key, sent_id, sentence)``, one row per sentence in text order."""
    bound_batches(df.sparkSession)
    return explode_rows(df, [key], sentence_array(F.col(text), keep_tail), ["sent_id", "sentence"])


def clean_sentences(df: DataFrame, key: str = "doc_id", text: str = "text",
                    split_long: int | None = None, min_words: int = 6) -> DataFrame:
    """Distinct stripped sentences per text, numbered by first occurrence.

    The reference's long-sentence split and five-word filter were overwritten
    before use and do not change the result; only the de-duplication stays.
    ``split_long=128`` switches on the intended form: sentences longer than
    that are also split at ``, ; : )`` and pieces of at least ``min_words``
    words join the set.
    """
    bound_batches(df.sparkSession)
    sents = sentence_array(F.col(text))
    if split_long is not None:
        pieces = F.flatten(F.transform(
            F.filter(sents, lambda s: F.length(s) > split_long),
            lambda s: F.filter(F.split(s, "[,;:)]", -1), lambda p: F.size(F.split(p, " ", -1)) >= min_words)))
        sents = F.transform(F.concat(sents, pieces), lambda s: F.trim(s))
    return explode_rows(df, [key], F.array_distinct(sents), ["sent_id", "sentence"])


#: paragraphs whose segments are gathered before they join the others
BLOCK_PARAGRAPHS = 128


def segment_array(text: Column, max_tokens: int = MAX_SEGMENT_TOKENS) -> Column:
    """array<struct<segment, n_tokens>>: non-empty paragraphs packed greedily;
    a segment takes paragraphs while it holds fewer than ``max_tokens``
    tokens (the last one may overshoot)."""
    paras = F.filter(F.split(text, "\n", -1), lambda p: F.length(p) > 0)
    seg = "struct<segment:string,n_tokens:int>"
    empty, none = F.array().cast(f"array<{seg}>"), F.lit(None).cast(seg)
    # every step of an aggregate copies its state, so the segments of a block of
    # paragraphs are gathered first and handed on block by block
    blocks = F.flatten(F.transform(F.array(paras), lambda x: F.transform(
        F.sequence(F.lit(0), ((F.size(x) - 1) / BLOCK_PARAGRAPHS).cast("int")),
        lambda i: F.slice(x, i * BLOCK_PARAGRAPHS + 1, BLOCK_PARAGRAPHS))))

    def step(acc, p):
        last, c = acc["open"], word_count(p)
        grown = F.struct(F.concat(last["segment"], F.lit(" "), p).alias("segment"), (last["n_tokens"] + c).alias("n_tokens"))
        one = F.struct(p.alias("segment"), c.alias("n_tokens"))
        return F.when(last.isNull(), F.struct(acc["done"].alias("done"), one.alias("open"))).when(
            last["n_tokens"] >= max_tokens, F.struct(F.concat(acc["done"], F.array(last)).alias("done"), one.alias("open"))
        ).otherwise(F.struct(acc["done"].alias("done"), grown.alias("open")))

    def block(acc, ps):
        return F.aggregate(ps, F.struct(empty.alias("done"), acc["open"].alias("open")), step, lambda st: F.struct(
            F.concat(acc["done"], st["done"]).alias("done"), st["open"].alias("open")))

    return F.aggregate(blocks, F.struct(empty.alias("done"), none.alias("open")), block, lambda st: F.when(
        st["open"].isNull(), st["done"]).otherwise(F.concat(st["done"], F.array(st["open"]))))


def pack_segments(df: DataFrame, key: str = "doc_id", text: str = "text",
                  max_tokens: int = MAX_SEGMENT_TOKENS) -> DataFrame:
    """``(key, seg_id, segment, n_tokens)``; token count = blank-separated words."""
    ex = explode_rows(df, [key], segment_array(F.col(text), max_tokens), ["seg_id", "s"])
    return ex.select(key, "seg_id", F.col("s.segment").alias("segment"), F.col("s.n_tokens").alias("n_tokens"))


def prompt(answer: Column, context: Column) -> Column:
    return F.concat(F.lit(ANSWER_TOKEN + " "), answer, F.lit(" " + CONTEXT_TOKEN + " "), context)


def extract_entities(sentences: DataFrame, key: str = "doc_id", pattern: str = ENTITY_PATTERN,
                     extractor_factory=None) -> DataFrame:
    """``(key, sent_id, sentence, ent_id, ent_text, label)``.

    Default: a regex extractor inside the JVM.  ``extractor_factory()`` may
    return a Python callable (an NER model in production) taking one sentence
    and returning a list of ``(text, label)``; it runs over Arrow batches,
    built once per task.
    """
    if extractor_factory is not None:
        from passagekit.operators.models import apply_batches
        import pandas as pd
        cols = [key, "sent_id", "sentence"]
        kt = sentences.schema[key].dataType.simpleString()
        schema = (f"{key} {kt}, sent_id int, sentence string, ent_id int, ent_text string, label string")

        def model():
            ner = extractor_factory()

            def run(b):
                rows = []
                for k, sid, sent in zip(b[key], b["sent_id"], b["sentence"]):
                    for i, (t, lab) in enumerate(ner(sent)):
                        rows.append((k, sid, sent, i, t, lab))
                return pd.DataFrame(rows, columns=[key, "sent_id", "sentence", "ent_id", "ent_text", "label"])
            return run
        return apply_batches(sentences.select(*cols), model, schema)
    ex = explode_rows(sentences, [key, "sent_id", "sentence"],
                      F.regexp_extract_all(F.col("sentence"), F.lit(pattern), 1), ["ent_id", "ent_text"])
    label = (F.when(F.col("ent_text").rlike("^[0-9]{4}$"), "DATE")
             .when(F.col("ent_text").rlike("^[0-9]+$"), "CARDINAL").otherwise("PROPER"))
    return ex.withColumn("label", label)


def pattern_extractor():
    """The default extractor as a plug-in (what an NER model replaces)."""
    import re
    pattern = re.compile(ENTITY_PATTERN)

    def label(text: str) -> str:
        if not text.isdigit():
            return "PROPER"
        return "DATE" if len(text) == 4 else "CARDINAL"
    return lambda sentence: [(t, label(t)) for t in pattern.findall(sentence)]


def build_choices(entities: DataFrame, key: str = "doc_id", n_choices: int = 4, seed: int = 0) -> DataFrame:
    """Multiple-choice options for every entity occurrence.

    Pool = distinct (text, label) of the passage; ``m = min(n_choices, |pool|) - 1``
    distractors: other entities with the same label first, then others,
    each in a seeded random order; the options are shuffled (seeded).
    Only the first ``m + 1`` entities per (passage, label) and ``2m`` per
    passage are ever needed, so no pairs of entities are formed.
    """
    m_max = n_choices - 1
    pool = entities.select(key, "ent_text", "label").distinct()
    pool = pool.withColumn("_h", unit_hash(F.col(key), "ent_text", "label", seed=seed))
    size = pool.groupBy(key).agg(F.count(F.lit(1)).alias("_pool"))
    same = (pool.withColumn("_r", F.row_number().over(
        Window.partitionBy(key, "label").orderBy("_h", "ent_text")))
        .where(F.col("_r") <= m_max + 1)
        .groupBy(key, "label").agg(F.array_sort(F.collect_list(F.struct("_h", "ent_text"))).alias("_same")))
    other = (pool.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_h", "ent_text", "label")))
             .where(F.col("_r") <= 2 * m_max)
             .groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_h", "ent_text", "label"))).alias("_other")))
    e = entities.join(size, key).join(same, [key, "label"]).join(other, key)
    m = F.least(F.lit(n_choices), F.col("_pool")) - 1
    own = F.filter("_same", lambda x: x["ent_text"] != F.col("ent_text"))
    first = F.slice(F.transform(own, lambda x: x["ent_text"]), 1, m)
    rest = F.transform(F.filter("_other", lambda x: x["label"] != F.col("label")), lambda x: x["ent_text"])
    need = m - F.size(first)
    picked = F.when(need > 0, F.concat(first, F.slice(rest, 1, need))).otherwise(first)
    wrong = F.transform(picked, lambda t: F.struct(t.alias("answer"), F.lit(False).alias("correct")))
    options = F.concat(F.array(F.struct(F.col("ent_text").alias("answer"), F.lit(True).alias("correct"))), wrong)
    keyed = F.transform(options, lambda o: F.struct(
        unit_hash(F.col(key), F.col("ent_text"), o["answer"], seed=seed).alias("_h"), o["answer"].alias("answer"),
        o["correct"].alias("correct")))
    shuffled = F.transform(F.array_sort(keyed), lambda o: F.struct(o["answer"].alias("answer"),
                                                                   o["correct"].alias("correct")))
    return e.select(key, "sent_id", "ent_id", "ent_text", "label", shuffled.alias("choices"))


def choices_text(choices: Column) -> Column:
    """Flat text form ``answer|true;answer|false;...`` for export and comparison."""
    return F.array_join(F.transform(choices, lambda c: F.concat(c["answer"], F.lit("|"),
                                                                c["correct"].cast("string"))), ";")


def candidate_id(kind: int, part: Column, item: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), part.cast("int").alias("part"), item.cast("int").alias("item"))


def candidate_text(cand: Column) -> Column:
    """Flat form ``kind:part:item`` for export."""
    return F.concat_ws(":", *(cand[c].cast("string") for c in ("kind", "part", "item")))


def build_candidates(df: DataFrame, key: str = "doc_id", text: str = "text", style: str = "all",
                     seed: int = 0, max_tokens: int = MAX_SEGMENT_TOKENS) -> DataFrame:
    """Question-generation inputs: ``(key, cand_id, style, answer, context, choices)``.

    * sentence style: every distinct sentence of every segment, context = segment;
    * multiple-choice style: every entity of every distinct sentence of the
      whole text, context = sentence, with options from ``build_choices``.
    ``cand_id`` = struct (kind, part, item) orders candidates as the reference
    produced them -- (0, segment, sentence), then (1, sentence, entity) -- and
    breaks score ties in ranking.  A key's candidates derive from its one row and
    are computed inside it; only keys of several rows are put together by joins.
    """
    parts, rest = build_parts(df, key, text, style, seed, max_tokens)
    return part_rows(parts, key).unionByName(rest)


def build_parts(df: DataFrame, key: str = "doc_id", text: str = "text", style: str = "all", seed: int = 0,
                max_tokens: int = MAX_SEGMENT_TOKENS) -> tuple[DataFrame, DataFrame]:
    """The candidates of ``build_candidates`` in two frames: ``with_parts`` of the keys of
    one row, and the rows of the candidates of all other keys."""
    if style not in STYLES:
        raise ValueError(f"Invalid answer style {style}. Please choose from {list(STYLES)}")
    many = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(key)
    known = df.where(F.col(key).isNotNull())
    own = with_parts(known.join(many, key, "left_anti").select(key, text), key, text, style, seed, max_tokens)
    rest = known.join(many, key, "left_semi").unionByName(df.where(F.col(key).isNull()))
    return own.select(key, "_parts"), _candidates_by_key(rest, key, text, style, seed, max_tokens)


def _candidates_by_key(df: DataFrame, key: str, text: str, style: str, seed: int, max_tokens: int) -> DataFrame:
    """``build_candidates`` for keys that several rows share: their entities are one pool."""
    parts = []
    if style in ("all", "sentences"):
        segs = pack_segments(df, key, text, max_tokens)
        s = explode_rows(segs, [key, "seg_id", "segment"], F.array_distinct(sentence_array(F.col("segment"))),
                         ["sent_id", "answer"])
        parts.append(s.select(
            key, candidate_id(0, F.col("seg_id"), F.col("sent_id")).alias("cand_id"),
            F.lit("sentences").alias("style"), "answer", F.col("segment").alias("context"),
            F.lit(None).cast("array<struct<answer:string,correct:boolean>>").alias("choices")))
    if style in ("all", "multiple_choice"):
        sents = clean_sentences(df, key, text)
        ents = extract_entities(sents, key)
        ch = build_choices(ents, key, seed=seed)
        mc = ents.join(ch.select(key, "sent_id", "ent_id", "choices"), [key, "sent_id", "ent_id"])
        parts.append(mc.select(
            key, candidate_id(1, F.col("sent_id"), F.col("ent_id")).alias("cand_id"),
            F.lit("multiple_choice").alias("style"), F.col("ent_text").alias("answer"),
            F.col("sentence").alias("context"), "choices"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tokenize_fixed(df: DataFrame, key: str, col: str, max_len: int, vocab: int = 30000) -> DataFrame:
    """``(key, window, ids, mask)``: consecutive fixed-length windows over all tokens.

    Lower-cased blank-separated tokens are hashed into ``1..vocab``; window w
    holds tokens w * max_len onwards, the last one padded with 0 (mask 0).  A
    text without tokens has one window of padding.
    """
    toks = F.filter(F.split(F.lower(F.col(col)), " ", -1), lambda t: t != "")
    ids = F.transform(toks, lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % vocab + 1)
                      .cast("int"))
    d = df.select(key, F.coalesce(ids, F.array().cast("array<int>")).alias("_ids"))
    last = F.greatest(F.lit(0), F.ceil(F.size("_ids") / F.lit(max_len)).cast("int") - 1)
    d = d.select(key, "_ids", F.explode(F.sequence(F.lit(0), last)).alias("window"))
    d = d.withColumn("_own", F.slice("_ids", F.col("window") * max_len + 1, F.lit(max_len)))
    pad = F.array_repeat(F.lit(0), F.lit(max_len) - F.size("_own"))
    return d.select(key, "window", F.concat("_own", pad).alias("ids"),
                    F.concat(F.array_repeat(F.lit(1), F.size("_own")), pad).alias("mask"))


def compose_passage(df: DataFrame, parts: list[str], sep: str = " [SEP] ", out: str = "passage") -> DataFrame:
    """Encoder input ``part1 [SEP] part2 [SEP] ...``; NULL parts become ''.

    One separator for every variant (title+text, text, +questions); the
    reference mixed '[SEP]' with and without blanks.
    """
    return df.withColumn(out, F.concat_ws(sep, *[F.coalesce(F.col(p), F.lit("")) for p in parts]))


# ---------------------------------------------------------------------------
# In-row forms.  Sentences, entities, the entity pool, options and candidates
# of a text all derive from that one row, so the default pipeline computes
# them with higher-order functions inside the row: no explode/join/window,
# no shuffle.  Cost per row is linear in the row's own text: the pool is cut
# to <= n_choices entries per label and 2(n_choices-1) overall before any
# per-entity work.
#
# Catalyst inlines a computed column into a lambda body when it is
# referenced there once, and a lambda body runs once per element.  So the
# steps below are separate columns, and per-row values reach per-element
# lambdas only as array arguments (zip_with + array_repeat), never as
# captured expressions.
CHOICE_TYPE = "array<struct<answer:string,correct:boolean>>"


def _label(e: Column) -> Column:
    # ':' follows '9': what starts later holds no number, and no pattern is tried
    return (F.when(e >= ":", "PROPER").when(e.rlike("^[0-9]{4}$"), "DATE").when(e.rlike("^[0-9]+$"), "CARDINAL")
            .otherwise("PROPER"))


def entity_array(sentences: Column, pattern: str = ENTITY_PATTERN) -> Column:
    """array<array<struct<sent_id, ent_id, ent_text, label>>>: the entities of each sentence.

    Without the sentences themselves: one that is a whole text has as many entities as
    the text, and a row with a copy of it for each would grow with the square of the text."""
    return F.transform(sentences, lambda s, j: F.transform(
        F.regexp_extract_all(s, F.lit(pattern), 1),
        lambda e, k: F.struct(j.alias("sent_id"), k.alias("ent_id"), e.alias("ent_text"), _label(e).alias("label"))))


def _repeat(value: Column, like: Column) -> Column:
    return F.array_repeat(value, F.size(like))


def with_entity_choices(df: DataFrame, key: str, text: str, out: str = "_ents_ch",
                        n_choices: int = 4, seed: int = 0) -> DataFrame:
    """Adds ``out``: array of struct<sent_id, ent_id, ent_text, label, choices> --
    the ``build_choices`` rule evaluated inside the row."""
    d = _with_sentence_choices(df, key, text, "_own_sents", "_own_ents", n_choices, seed)
    return d.withColumn(out, F.flatten("_own_ents")).drop("_own_sents", "_own_ents")


def _with_sentence_choices(df: DataFrame, key: str, text: str, sentences: str, out: str,
                           n_choices: int = 4, seed: int = 0) -> DataFrame:
    """Adds ``sentences``, the distinct sentences of the text, and ``out``: the entities of
    each with their options."""
    bound_batches(df.sparkSession)
    m_max = n_choices - 1
    k = F.col(key)
    df = df.withColumn(sentences, F.array_distinct(sentence_array(F.col(text))))
    df = df.withColumn("_ents", entity_array(F.col(sentences)))
    # strings are made distinct by hashing (structs would be compared pair by pair); the text gives the label
    df = df.withColumn("_keys", F.array_distinct(F.transform(F.flatten("_ents"), lambda e: e["ent_text"])))
    df = df.withColumn("_pool", F.sort_array(F.transform(
        F.transform("_keys", lambda x: F.struct(x.alias("ent_text"), _label(x).alias("label"))), lambda e: F.struct(
            hash_order(k, e["ent_text"], e["label"], seed=seed).alias("h"),
            e["ent_text"].alias("ent_text"), e["label"].alias("label")))))
    df = df.withColumn("_labels", F.array_distinct(F.transform("_pool", lambda p: p["label"])))

    def texts_by_label(entities, wanted):
        return F.map_from_arrays(F.col("_labels"), F.zip_with(
            "_labels", _repeat(entities, F.col("_labels")),
            lambda lb, own: F.transform(F.filter(own, lambda p: wanted(p["label"], lb)), lambda p: p["ent_text"])))

    same = F.transform_values(texts_by_label(F.col("_pool"), lambda p, lb: p == lb),
                              lambda _, own: F.slice(own, 1, m_max + 1))
    ctx = F.struct(same.alias("same"),
                   texts_by_label(F.slice("_pool", 1, 2 * m_max), lambda p, lb: p != lb).alias("other"),
                   (F.least(F.lit(n_choices), F.size("_pool")) - 1).alias("m"))

    def options(e, c):
        # the first m of the others with the same label, then of those with another
        picked = F.slice(F.concat(F.array_remove(F.element_at(c["same"], e["label"]), e["ent_text"]),
                                  F.element_at(c["other"], e["label"])), 1, c["m"])

        def keyed(answer, correct):
            return F.struct(hash_order(k, e["ent_text"], answer, seed=seed).alias("h"), answer.alias("answer"),
                            F.lit(correct).alias("correct"))
        opts = F.concat(F.array(keyed(e["ent_text"], True)), F.transform(picked, lambda t: keyed(t, False)))
        return F.transform(F.sort_array(opts), lambda o: F.struct(
            o["answer"].alias("answer"), o["correct"].alias("correct")))

    df = df.withColumn(out, F.zip_with("_ents", _repeat(ctx, F.col("_ents")), lambda own, c: F.transform(
        own, lambda e: F.struct(
            e["sent_id"].alias("sent_id"), e["ent_id"].alias("ent_id"), e["ent_text"].alias("ent_text"),
            e["label"].alias("label"), options(e, c).alias("choices")))))
    return df.drop("_ents", "_keys", "_pool", "_labels")


def with_parts(df: DataFrame, key: str, text: str, style: str = "all", seed: int = 0,
               max_tokens: int = MAX_SEGMENT_TOKENS, out: str = "_parts") -> DataFrame:
    """Adds ``out``: array<struct<kind, part, style, context, items>>, the candidates of a text
    under the context that they share; items: array<struct<item, answer, choices>>.

    A segment or sentence stands here once, however many candidates it has, so the row
    is as long as its text.
    """
    if style not in STYLES:
        raise ValueError(f"Invalid answer style {style}. Please choose from {list(STYLES)}")
    bound_batches(df.sparkSession)

    def one(kind: int, name: str, part: Column, context: Column, items: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), part.alias("part"), F.lit(name).alias("style"),
                        context.alias("context"), items.alias("items"))

    parts = []
    if style in ("all", "sentences"):
        df = df.withColumn("_segs", F.transform(segment_array(F.col(text), max_tokens), lambda sg: sg["segment"]))
        df = df.withColumn("_sents", sentence_arrays(F.col("_segs")))
        parts.append(F.transform(
            F.zip_with("_segs", "_sents", lambda sg, own: F.struct(sg.alias("segment"), own.alias("own"))),
            lambda z, i: one(0, "sentences", i, z["segment"], F.transform(F.array_distinct(z["own"]), lambda x, j: F.struct(
                j.alias("item"), x.alias("answer"), F.lit(None).cast(CHOICE_TYPE).alias("choices"))))))
    if style in ("all", "multiple_choice"):
        df = _with_sentence_choices(df, key, text, "_own_sents", "_own_ents", seed=seed)
        parts.append(F.transform(
            F.zip_with("_own_sents", "_own_ents", lambda s, own: F.struct(s.alias("sentence"), own.alias("own"))),
            lambda z, i: one(1, "multiple_choice", i, z["sentence"], F.transform(z["own"], lambda e: F.struct(
                e["ent_id"].alias("item"), e["ent_text"].alias("answer"), e["choices"].cast(CHOICE_TYPE).alias("choices"))))))
    df = df.withColumn(out, parts[0] if len(parts) == 1 else F.concat(*parts))
    return df.drop("_segs", "_sents", "_own_sents", "_own_ents")


def candidates_of(parts: Column, use) -> Column:
    """``use(part, item)`` of every candidate of an array of parts, in candidate order."""
    return F.flatten(F.transform(parts, lambda p: F.transform(p["items"], lambda x: use(p, x))))


def part_id(p: Column, x: Column) -> Column:
    """``candidate_id`` of an item of a part."""
    return F.struct(p["kind"].alias("kind"), p["part"].cast("int").alias("part"), x["item"].cast("int").alias("item"))


def part_rows(df: DataFrame, key: str, parts: str = "_parts") -> DataFrame:
    """``(key, cand_id, style, answer, context, choices)``: a row for every candidate.

    Exploded context by context, so that no row holds copies of one."""
    rows = explode_rows(df, [key], F.col(parts), ["_p"])
    rows = explode_rows(rows, [key, "_p"], F.col("_p.items"), ["_x"])
    return rows.select(key, part_id(F.col("_p"), F.col("_x")).alias("cand_id"), "_p.style", "_x.answer", "_p.context",
                       "_x.choices")


def with_candidates(df: DataFrame, key: str, text: str, style: str = "all", seed: int = 0,
                    max_tokens: int = MAX_SEGMENT_TOKENS, out: str = "_cands") -> DataFrame:
    """Adds ``out``: array<struct<cand_id, style, answer, context, choices>>,
    the same candidates and ids as ``build_candidates``.

    Every candidate has its own copy of its context: for texts of many thousand
    words use ``with_parts``."""
    d = with_parts(df, key, text, style, seed, max_tokens)
    return d.withColumn(out, candidates_of(F.col("_parts"), lambda p, x: F.struct(
        part_id(p, x).alias("cand_id"), p["style"].alias("style"), x["answer"].alias("answer"),
        p["context"].alias("context"), x["choices"].alias("choices")))).drop("_parts")
