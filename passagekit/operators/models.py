"""Pluggable batch models: question generator, QA scorer, text encoder.

The reference called GPU models row by row (or in mini-batches of 7-64).
Here a model is any Python callable applied to Arrow batches with
``mapInPandas``: the model object is built once per task by a factory and
sees ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows at a time.  When
no model is given, a deterministic default runs as Spark SQL expressions
(no Python at all), which is what the tests and the oracle compare.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagekit.functions.arrays import explode_rows
from passagekit.session import bound_batches, ship_package


#: rows, and batches' worth of tokens, that a task holds while it sorts them by length
BUFFER_ROWS, BUFFER_BUDGETS = 4096, 64
#: rows, and characters, of one call of a model whose rows stand in arrays
CALL_ROWS, CALL_CHARS = 1024, 1 << 22
#: distinct tokens whose hashes an encoder keeps
CACHED_TOKENS = 1 << 20


def budget_batches(lengths: np.ndarray, budget: int) -> list[np.ndarray]:
    """Rows (positions) cut into batches of similar length: rows x longest row stays within ``budget``.

    A row that is longer than the budget is a batch of its own.
    """
    order = np.argsort(lengths, kind="stable")
    out, begin = [], 0
    for at, size in enumerate(lengths[order].tolist()):
        if at > begin and (at - begin + 1) * size > budget:
            out.append(order[begin:at])
            begin = at
    return out + [order[begin:]] if len(order) else out


def padding_share(batches: list[np.ndarray], lengths: np.ndarray) -> float:
    """Share of a padded batch's places that hold no token, over all batches."""
    padded = sum(len(b) * int(lengths[b].max()) for b in batches if len(b))
    return 1 - int(lengths.sum()) / padded if padded else 0.0


def apply_budgeted(df: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
                   schema: T.StructType | str, length: Column, budget: int) -> DataFrame:
    """``apply_batches`` with batches sized for the model instead of for Arrow.

    ``length``: tokens of a row.  Rows of a task are gathered in a bounded buffer,
    sorted by length and cut by ``budget_batches``; results come in that order, all
    of a buffer as one Arrow batch (a batch of the model may be a single row).
    """
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        held: list[pd.DataFrame] = []
        tokens = rows = 0

        def flush() -> Iterator[pd.DataFrame]:
            whole = pd.concat(held, ignore_index=True)
            cuts = budget_batches(whole.pop("_length").to_numpy(np.int64), budget)
            whole = whole.iloc[np.concatenate(cuts)].reset_index(drop=True)
            ends = np.cumsum([len(at) for at in cuts]).tolist()
            yield pd.concat([model(whole.iloc[a:b].reset_index(drop=True)) for a, b in zip([0, *ends], ends)],
                            ignore_index=True)

        for batch in batches:
            ends = batch["_length"].cumsum().to_numpy()
            begin = 0
            while begin < len(batch):
                room = max(1, BUFFER_BUDGETS * budget - tokens) + (ends[begin - 1] if begin else 0)
                end = min(max(begin + 1, int(np.searchsorted(ends, room, side="right"))), begin + BUFFER_ROWS - rows)
                held.append(batch.iloc[begin:end])
                rows, tokens = rows + end - begin, tokens + int(held[-1]["_length"].sum())
                begin = end
                if rows >= BUFFER_ROWS or tokens >= BUFFER_BUDGETS * budget or begin < len(batch):
                    yield from flush()
                    held, rows, tokens = [], 0, 0
        if held:
            yield from flush()

    return df.withColumn("_length", F.coalesce(length, F.lit(0)).cast("long")).mapInPandas(run, schema)


def item_batches(batch: pd.DataFrame, items: list[str], rows: int = CALL_ROWS,
                 chars: int = CALL_CHARS) -> Iterator[pd.DataFrame]:
    """A frame with one row per element of the array columns ``items`` (of equal length in a
    row), in pieces of at most ``rows`` rows or about ``chars`` characters.

    The other values are the same objects in all rows of an array: a long text is not copied."""
    counts = np.array([len(x) for x in batch[items[0]]], np.int64)
    at = np.repeat(np.arange(len(batch)), counts)
    if not len(at):
        return
    held = {c: (np.concatenate([np.asarray(x, object) for x in batch[c]]) if c in items
                else batch[c].astype(object).to_numpy()) for c in batch.columns}

    def size(values: np.ndarray) -> np.ndarray:
        return np.array([len(v) if isinstance(v, str) else 0 for v in values], np.int64)

    total = np.cumsum(sum(size(v) if c in items else size(v)[at] for c, v in held.items()))
    begin = 0
    while begin < len(at):
        room = chars + (int(total[begin - 1]) if begin else 0)
        end = min(begin + rows, max(begin + 1, int(np.searchsorted(total, room, side="right"))))
        yield pd.DataFrame({c: v[begin:end] if c in items else v[at[begin:end]] for c, v in held.items()}, dtype=object)
        begin = end


def apply_batches(df: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
                  schema: T.StructType | str) -> DataFrame:
    """Run ``factory()(batch)`` over Arrow batches; the model is built once per task.

    A model may also return an iterator of frames, whose rows need not be held together."""
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for b in batches:
            out = model(b)
            yield from [out] if isinstance(out, pd.DataFrame) else out
    return df.mapInPandas(run, schema)


# ----------------------------------------------------------------- defaults (JVM side)
def _words(c: Column) -> Column:
    return F.array_remove(F.split(F.lower(c), " ", -1), "")


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also inside a lambda body, where
    an expression that is named twice is evaluated twice."""
    return F.transform(F.array(value), use)[0]


def default_question(answer: Column, context: Column, style: Column) -> Column:
    """Stand-in generator (a seq2seq model in production): a cloze over the
    whole sentence -- the entity blanked in its sentence for multiple-choice
    candidates, the sentence's first longest word blanked otherwise."""
    cloze = F.concat(F.replace(context, answer, F.lit("____")), F.lit("?"))
    measured = _once(F.split(answer, " ", -1), lambda ws: F.struct(
        ws.alias("words"), F.transform(ws, lambda w: F.length(w)).alias("lengths")))
    longest = _once(measured, lambda x: F.element_at(
        x["words"], F.array_position(x["lengths"], F.array_max(x["lengths"])).cast("int")))
    blanked = _once(longest, lambda w: F.when(w == "", answer).otherwise(F.replace(answer, w, F.lit("____"))))
    return F.when(style == "multiple_choice", cloze).otherwise(F.concat(blanked, F.lit("?")))


def correct_answer(answer: Column, choices: Column) -> Column:
    """For multiple-choice candidates the option flagged correct, else the answer."""
    pick = F.element_at(F.filter(choices, lambda c: c["correct"]), 1)["answer"]
    return F.when(choices.isNull(), answer).otherwise(pick)


def default_score(question: Column, answer: Column) -> Column:
    """Stand-in QA evaluator: Jaccard overlap of the lower-cased word sets."""
    def overlap(w):
        inter = F.size(F.array_intersect(w["q"], w["a"]))
        return _once(F.size(F.array_union(w["q"], w["a"])),
                     lambda union: F.when(union == 0, F.lit(0.0)).otherwise(inter.cast("double") / union))
    return _once(F.struct(_words(question).alias("q"), _words(answer).alias("a")), overlap)


# ----------------------------------------------------------------- the defaults as batch models
def cloze_generator() -> Callable[[pd.DataFrame], list[str]]:
    """``default_question`` as a plug-in generator (what a seq2seq model replaces)."""
    def generate(batch: pd.DataFrame) -> list[str]:
        out = []
        for answer, context, style in zip(batch["answer"], batch["context"], batch["style"]):
            blank = answer if style == "multiple_choice" else max(answer.split(" "), key=len)
            whole = context if style == "multiple_choice" else answer
            out.append((whole.replace(blank, "____") if blank else whole) + "?")
        return out
    return generate


def overlap_scorer() -> Callable[[pd.Series, pd.Series], list[float]]:
    """``default_score`` as a plug-in scorer."""
    def score(questions: pd.Series, answers: pd.Series) -> list[float]:
        pairs = [[set(x.lower().split(" ")) - {""} for x in p] for p in zip(questions, answers)]
        return [len(q & a) / len(q | a) if q | a else 0.0 for q, a in pairs]
    return score


# ----------------------------------------------------------------- hashed bag-of-words encoder
def token_bucket(token: Column, dim: int) -> Column:
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dim).cast("int")


def hash_encode_sparse(df: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """``(key, bucket, weight)``: L2-normalised term counts of hashed tokens.

    Pure SQL: explode tokens, count per (key, bucket), divide by the norm of
    the row (a window over one text's buckets, at most ``dim`` rows)."""
    from pyspark.sql import Window
    toks = explode_rows(df, [key], _words(F.col(text)), ["_t"])
    tf = toks.groupBy(key, token_bucket(F.col("_t"), dim).alias("bucket")).agg(
        F.count(F.lit(1)).cast("double").alias("_tf"))
    norm = F.sqrt(F.sum(F.col("_tf") * F.col("_tf")).over(Window.partitionBy(key)))
    return tf.select(key, "bucket", (F.col("_tf") / norm).alias("weight"))


def hashed_bow_vector(text: Column, dim: int = 64) -> Column:
    """The hashed bag-of-words encoder as one JVM expression: array<double>(dim).

    Tokens are hashed once; per-bucket counts and the norm enter the
    per-element lambdas as arguments (zip_with + array_repeat), never as
    captured expressions, so nothing is recomputed per element.
    """
    buckets = F.transform(_words(text), lambda t: token_bucket(t, dim))
    counts = F.zip_with(F.sequence(F.lit(0), F.lit(dim - 1)), F.array_repeat(buckets, dim),
                        lambda i, bs: F.size(F.filter(bs, lambda b: b == i)).cast("double"))
    return counts


def _normalise(counts: Column, dim: int) -> Column:
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c))
    return F.zip_with(counts, F.array_repeat(norm, dim),
                      lambda c, n: F.when(n > 0, c / n).otherwise(F.lit(0.0)))


def hashed_bow_encoder(dim: int = 64) -> Callable[[pd.Series], np.ndarray]:
    """Python form of the same encoder, for ``encode`` (Arrow batches).

    Each distinct token is hashed once (cached across the batches of a task, up to
    ``CACHED_TOKENS``), counts of a whole batch are one ``np.bincount``.
    """
    cache: dict[str, int] = {}

    def bucket(tok: str) -> int:
        if len(cache) >= CACHED_TOKENS:
            cache.clear()
        found = cache[tok] = int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16) % dim
        return found

    def encode_batch(texts: pd.Series) -> np.ndarray:
        known = cache.get
        places, lengths = [], np.zeros(len(texts), np.int64)
        for row, text in enumerate(texts.to_numpy()):
            if isinstance(text, str):
                own = [bucket(t) if (at := known(t)) is None else at for t in text.lower().split(" ") if t]
                lengths[row] = len(own)
                places += own
        at = np.repeat(np.arange(len(texts)) * dim, lengths) + np.array(places, np.int64)
        out = np.bincount(at, minlength=len(texts) * dim).astype(np.float64).reshape(len(texts), dim)
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        np.divide(out, norms, out=out, where=norms > 0)
        return out
    return encode_batch


def encode(df: DataFrame, key: str, text: str, encoder_factory=None, dim: int = 64,
           out: str = "embedding", keep: list[str] | None = None, engine: str = "arrow",
           budget: int | None = None) -> DataFrame:
    """Dense vectors ``(key, *keep, embedding array<double>)``.

    ``encoder_factory()`` returns a callable ``pd.Series[str] -> ndarray[n, dim]``
    (a transformer encoder in production), applied over Arrow batches;
    default: the hashed bag of words.  ``engine="sql"`` computes the same
    default vectors as a JVM expression (``hashed_bow_vector``, dim x tokens
    interpreted lambda calls per row); the Arrow path stays the default
    because a real encoder is a Python model anyway.
    ``keep`` columns travel along (no join back to the source).
    ``budget``: places (rows x words of the longest row) of one call of the
    encoder; rows of similar length go together.
    """
    cols = [key] + list(keep or [])
    if encoder_factory is None and engine == "sql":
        d = df.select(*cols, hashed_bow_vector(F.col(text), dim).alias("_counts"))
        return d.select(*cols, _normalise(F.col("_counts"), dim).alias(out))
    factory = encoder_factory or (lambda: hashed_bow_encoder(dim))
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in cols)

    def model():
        enc = factory()

        def run(b: pd.DataFrame) -> pd.DataFrame:
            m = enc(b[text])
            res = b[cols].copy()
            res[out] = list(m)
            return res
        return run
    result = f"{schema}, {out} array<double>"
    if budget is not None:
        return apply_budgeted(df.select(*cols, text), model, result, F.size(F.split(text, " ", -1)), budget)
    return apply_batches(df.select(*cols, text), model, result)
