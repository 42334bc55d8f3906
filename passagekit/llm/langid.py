"""Language identification with error-correcting output codes.

Every language has a codeword of +1/-1 bits.  One binary logistic classifier
per bit, over hashed byte 3-grams of the whole lower-cased text, predicts that
bit; decoding chooses the language whose codeword has the least total logistic
loss and flags a text as ambiguous when its share of the loss-weighted belief
is below ``AMBIGUOUS``.

The classifiers are fitted on at most about ``SAMPLE_ROWS`` labelled rows (the
same number per language, chosen by a hash of id and text); scoring reads every
text to its end, in blocks of bounded memory.

Defined cases: a text that is NULL or has no letter is ``und`` with score 0; so
is every text when nothing can be learned (no labelled row); rows without a
label or id are never learned from; repeated rows are scored one by one; other
columns are carried only if named in ``carry``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from passagekit.llm.common import map_batches, slices

FEATURES = 1 << 13
SAMPLE_ROWS = 2000
BLOCK = 1 << 20
AMBIGUOUS = 0.5
SLICE_BYTES = 4 << 20


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray    # languages x bits
    weights: np.ndarray  # features x bits
    bias: np.ndarray


def ngram_shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3-grams of the text and the square roots of their shares."""
    raw = b" " + text.lower().encode("utf-8", "replace") + b" "
    counts = np.zeros(FEATURES, dtype=np.int64)
    for at in range(0, len(raw) - 2, BLOCK):
        a = np.frombuffer(raw[at:at + BLOCK + 2], dtype=np.uint8).astype(np.uint32)
        gram = (a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761)
        counts += np.bincount(gram >> np.uint32(19), minlength=FEATURES)
    at = np.flatnonzero(counts)
    return at, np.sqrt(counts[at] / max(1, counts.sum()))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """Every split of the languages for up to 5 of them, else the best of some random codes."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:
        bits = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(bits, dtype=float).T
    rng = np.random.default_rng(seed)
    width = int(np.ceil(10 * np.log2(n)))

    def nearest(code: np.ndarray) -> float:
        agree = code @ code.T
        np.fill_diagonal(agree, -width)
        return agree.max()

    return min((rng.choice([-1.0, 1.0], size=(n, width)) for _ in range(50)), key=nearest)


def fit_bits(x: np.ndarray, target: np.ndarray, steps: int = 200, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression of every bit (+1/-1) at once, by accelerated gradient steps."""
    n = max(1, len(x))
    w = np.zeros((x.shape[1], target.shape[1]), dtype=np.float32)
    b = np.zeros(target.shape[1], dtype=np.float32)
    w_old, b_old = w, b
    for k in range(steps):
        pull = k / (k + 3)
        v, c = w + pull * (w - w_old), b + pull * (b - b_old)
        slope = -target / (1 + np.exp(np.clip(target * (x @ v + c), -30, 30))) / n
        w_old, b_old = w, b
        w, b = v - 4 * (x.T @ slope + ridge * v), c - slope.sum(0)
        w, b = w.astype(np.float32), b.astype(np.float32)
    return w, b


def sample_rows(df: DataFrame, label_col: str, key: list[str], most: int) -> DataFrame:
    """About ``most`` rows, the same number for each label, chosen by a hash of ``key``."""
    counts = {r[0]: r[1] for r in df.groupBy(label_col).agg(F.count(F.lit(1))).collect()}  # a row per label
    share: Column = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col(label_col) == F.lit(label), F.lit(most / len(counts) / n)).otherwise(share)
    point = F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.where(point < share).limit(2 * most)


def labelled_sample(df: DataFrame, labels: DataFrame, learn: Column, text_col: str, id_col: str,
                    label_col: str, most: int) -> DataFrame:
    """Rows (id, label, text) of about ``most`` labelled documents, one per id.

    Ids are drawn from the narrow label table, so only the sample (bounded by
    2 * ``most`` ids) is broadcast to the scan of the documents.
    """
    known = labels.where(learn & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(
        F.max(label_col).cast("int").alias("label"))
    ids = sample_rows(known, "label", ["id"], most)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(F.broadcast(ids), "id").dropDuplicates(["id"]).select("id", "label", "text")


def fit(df: DataFrame, learn: Column, lang_col: str = "lang", text_col: str = "text",
        id_col: str = "doc_id", most: int = SAMPLE_ROWS) -> Model:
    """Classifiers learned from the rows where ``learn`` holds and the language is known."""
    rows = df.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    chosen = sample_rows(rows, "lang", ["id", "text"], most).select("lang", "text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            found = [ngram_shares(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())),
                 pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))],
                ["lang", "at", "value"])

    got = map_batches(chosen, step, "lang string, at array<int>, value array<float>").toPandas()
    langs = sorted(got["lang"].unique())
    x = np.zeros((len(got), FEATURES), dtype=np.float32)
    for k, (at, value) in enumerate(zip(got["at"], got["value"])):
        x[k, at] = value
    codes = codewords(len(langs))
    if not langs:
        return Model([], codes, np.zeros((FEATURES, 0)), np.zeros(0))
    target = codes[got["lang"].map({v: k for k, v in enumerate(langs)}).to_numpy(dtype=int)].astype(np.float32)
    return Model(langs, codes, *fit_bits(x, target))


def decode_text(model: Model, text: str | None) -> tuple[str, float, bool]:
    """Language, its share of the loss-weighted belief, and whether that is ambiguous."""
    if not model.langs or not has_letter(text):
        return "und", 0.0, True
    at, value = ngram_shares(text)
    margin = model.codes * (value.astype(np.float32) @ model.weights[at] + model.bias)
    loss = np.logaddexp(0, -margin).sum(1)
    belief = np.exp(loss.min() - loss)
    best = int(loss.argmin())
    share = float(belief[best] / belief.sum())
    return model.langs[best], share, share < AMBIGUOUS


def predict(df: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Rows (*carry, lang_pred, score, ambiguous) for every row of ``df``."""
    carry = list(carry or [])
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*(df.schema[c] for c in carry), StructField("lang_pred", StringType()),
                         StructField("score", DoubleType()), StructField("ambiguous", BooleanType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, text_col, SLICE_BYTES):
            found = [decode_text(model, t) for t in batch.column(text_col).to_pylist()]
            lang, score, ambiguous = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carry), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(ambiguous, pa.bool_())], schema.names)

    return map_batches(df.select(*dict.fromkeys([*carry, text_col])), step, schema)
