"""Toxicity scoring with Levenshtein automata over a lexicon trie.

The lexicon is learned from labelled documents: words, and stems that only
begin words, found far more often in toxic than in clean documents.  Its trie is
intersected with the Levenshtein automaton of one edit (for words of five
letters or more): the product, made deterministic, is a table of states by
letter classes.  All tokens of a batch walk through it together, one letter at a
time, and most leave at once, so misspelled terms cost no more than exact ones.

Every hit is scored by its context: the weight of other hits within
``WINDOW`` tokens adds to it, and hits inside quotation marks without such
company (mention, not abuse) count less.  A logistic model over the document's
hits gives the score.

Learning uses at most about ``SAMPLE_ROWS`` labelled rows (half of each label,
chosen by a hash of id and text) and keeps at most ``TERMS`` terms; scoring
reads every text to its end.

Defined cases: a NULL or empty text has no hit and the score of the model's
intercept; with no labelled row of either kind every score is 0; rows with a
NULL id or label are never learned from; repeated rows are scored one by one;
other columns are carried only if named in ``carry``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from passagekit.llm.common import map_batches, slices, strings
from passagekit.llm.langid import labelled_sample

SAMPLE_ROWS = 8000
TERMS = 200
STEM_CHARS = range(3, 11)
LEAST_DOCS = 5
LEAST_SHARE = 0.005
FUZZY_CHARS = 5
WINDOW = 20
SLICE_BYTES = 2 << 20
EXACT, STEM, FUZZY = 1, 2, 3
FEATURES = ["exact", "stem", "fuzzy", "weight", "density", "company", "quoted"]


@cache
def word_chars() -> np.ndarray:
    """For every code point: is it a letter or digit?"""
    return np.array([chr(c).isalnum() for c in range(0x110000)], dtype=bool)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")


def tokens(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters and digits."""
    inside = np.zeros(len(code) + 2, dtype=np.int8)
    inside[1:-1] = word_chars()[code]
    turn = np.diff(inside)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


@dataclass
class Automaton:
    """Deterministic product of the lexicon's trie and the one-edit automaton."""

    letter: np.ndarray   # class of every code point, 0 for letters outside the lexicon
    step: np.ndarray     # states x classes; state 0 is dead, 1 the start
    term: np.ndarray     # term accepted when a token ends in the state, or -1
    kind: np.ndarray     # EXACT, STEM or FUZZY


@dataclass
class Model:
    terms: list[tuple[str, int, float]] = field(default_factory=list)  # text, EXACT or STEM, weight
    automaton: Automaton | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    coef: np.ndarray | None = None
    intercept: float = 0.0


def build(terms: list[tuple[str, int, float]]) -> Automaton:
    """Subset construction over (trie node, edits) pairs; a stem, once read, stays accepted."""
    alphabet = sorted({c for t, _, _ in terms for c in t})
    letter = np.zeros(0x110000, dtype=np.uint8 if len(alphabet) < 255 else np.uint16)
    for k, c in enumerate(alphabet):
        letter[ord(c)] = k + 1
    children: list[dict[int, int]] = [{}]
    word_at, stem_at, fuzzy = {}, {}, [False]
    for k, (text, kind, _) in enumerate(terms):
        node, path = 0, [0]
        for c in text:
            code = int(letter[ord(c)])
            if code not in children[node]:
                children[node][code] = len(children)
                children.append({})
                fuzzy.append(False)
            path.append(node := children[node][code])
        (word_at if kind == EXACT else stem_at)[node] = k
        if kind == EXACT and len(text) >= FUZZY_CHARS:
            for node in path:
                fuzzy[node] = True

    def closed(items: set) -> frozenset:
        """With a letter of the term left out."""
        return frozenset(items | {(child, 1) for node, edits in items if edits == 0
                                  for child in children[node].values() if fuzzy[child]})

    def after(items: frozenset, code: int) -> frozenset:
        out = set()
        for node, edits in items:
            if edits < 0:  # a stem was read
                out.add((node, edits))
                continue
            if edits == 0 and node in stem_at:
                out.add((node, -1))
            child = children[node].get(code)
            if child is not None and (edits == 0 or fuzzy[child]):
                out.add((child, edits))
            if edits == 0 and fuzzy[node]:
                out.add((node, 1))
                out.update((other, 1) for c, other in children[node].items() if c != code and fuzzy[other])
        return closed(out)

    first = closed({(0, 0)})
    number, queue, rows = {frozenset(): 0, first: 1}, [first], [[0] * (len(alphabet) + 1)]
    for items in queue:
        row = []
        for code in range(len(alphabet) + 1):
            to = after(items, code)
            if to not in number:
                number[to] = len(number)
                queue.append(to)
            row.append(number[to])
        rows.append(row)
    term, kind = np.full(len(number), -1), np.zeros(len(number), dtype=np.int8)
    for items, state in number.items():
        found = [(EXACT, word_at[n]) for n, e in items if e == 0 and n in word_at]
        found += [(STEM, stem_at[n]) for n, e in items if e <= 0 and n in stem_at]
        found += [(FUZZY, word_at[n]) for n, e in items if e == 1 and n in word_at
                  and len(terms[word_at[n]][0]) >= FUZZY_CHARS]
        if found:
            kind[state], term[state] = min(found)
    return Automaton(letter, np.array(rows, dtype=np.int32), term, kind)


def walk(auto: Automaton, code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Final state of every token; all tokens take a letter at a time and leave when dead."""
    final = np.zeros(len(start), dtype=np.int32)
    active, state, at = np.arange(len(start)), np.ones(len(start), dtype=np.int32), start.copy()
    letters = auto.letter[code]
    while len(active):
        state = auto.step[state, letters[at]]
        at = at + 1
        over = at == end[active]
        final[active[over]] = state[over]
        live = (state != 0) & ~over
        active, state, at = active[live], state[live], at[live]
    return final


def describe(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of each text, and its number of hits."""
    out, hits = np.zeros((len(texts), len(FEATURES))), np.zeros(len(texts), dtype=np.int64)
    if model.automaton is None or not texts:
        return out, hits
    lowered = [t.lower() for t in texts]
    size = np.array([len(t) + 1 for t in lowered])
    code = points("\n".join(lowered) + "\n")
    start, end = tokens(code)
    doc = np.searchsorted(np.cumsum(size), start, side="right")
    final = walk(model.automaton, code, start, end)
    kind = model.automaton.kind[final]
    weights = np.array([w for _, _, w in model.terms])
    n_tokens = np.bincount(doc, minlength=len(texts))
    first_token = np.cumsum(n_tokens) - n_tokens
    hit = np.flatnonzero(kind)
    hits += np.bincount(doc[hit], minlength=len(texts))
    for k in np.flatnonzero(hits):
        own = hit[np.searchsorted(doc[hit], k):np.searchsorted(doc[hit], k, side="right")]
        kinds, place = kind[own], own - first_token[k]
        weight = weights[model.automaton.term[final[own]]]
        # other hits within the window, by prefix sums
        total = np.r_[0.0, np.cumsum(weight)]
        near = (total[np.searchsorted(place, place + WINDOW, side="right")]
                - total[np.searchsorted(place, place - WINDOW)] - weight)
        text, origin = lowered[k], int(np.cumsum(size)[k] - size[k])
        quoted = quoted_at(text, start[own] - origin) & (near <= 0)
        out[k] = [np.log1p((kinds == EXACT).sum()), np.log1p((kinds == STEM).sum()),
                  np.log1p((kinds == FUZZY).sum()), np.log1p((weight * ~quoted).sum()),
                  np.log1p(1000 * len(own) / n_tokens[k]), np.log1p(near.max()), quoted.mean()]
    return out, hits


def quoted_at(text: str, places: np.ndarray) -> np.ndarray:
    """Does each place (ascending) lie inside quotation marks of its line?  Marks are counted as the text goes on."""
    out, last, straight, open_marks = [], 0, 0, 0
    for at in places.tolist():
        line = text.rfind("\n", last, at) + 1
        if line:
            last, straight, open_marks = line, 0, 0
        straight += text.count('"', last, at)
        open_marks += sum(text.count(m, last, at) for m in "“«") - sum(text.count(m, last, at) for m in "”»")
        last = at
        out.append(straight % 2 == 1 or open_marks > 0)
    return np.array(out, dtype=bool)


def term_counts(rows: DataFrame) -> DataFrame:
    """Documents per (term, kind) and label: words, and beginnings of words (whole words too)."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {0: Counter(), 1: Counter()}
        for batch in slices(batches, "text", SLICE_BYTES):
            for text, label in zip(strings(batch.column("text")), batch.column("label").to_pylist()):
                low = text.lower()
                code = points(low)
                words = {low[a:b] for a, b in zip(*(x.tolist() for x in tokens(code))) if b - a >= 3}
                found[label].update((w, EXACT) for w in words)
                found[label].update({(w[:n], STEM) for w in words for n in STEM_CHARS if len(w) >= n})
                if sum(map(len, found.values())) > 500_000:
                    yield from flush(found)
        yield from flush(found)

    def flush(found: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
        for label, counter in found.items():
            if counter:
                texts, kinds = zip(*counter)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(texts, pa.string()), pa.array(kinds, pa.int32()),
                     pa.array([label] * len(texts), pa.int32()), pa.array(list(counter.values()), pa.int64())],
                    ["term", "kind", "label", "n"])
                counter.clear()

    counted = map_batches(rows.select("text", "label"), step, "term string, kind int, label int, n long")
    return counted.groupBy("term", "kind").agg(
        F.sum(F.col("n") * F.col("label")).alias("toxic"), F.sum(F.col("n") * (1 - F.col("label"))).alias("clean"))


def choose_terms(found: list[tuple[str, int, int, int]], n_toxic: int, n_clean: int) -> list[tuple[str, int, float]]:
    """The lexicon: (text, kind, weight); a stem's longer forms and covered words are left out.

    A word that alone reaches half of a beginning's toxic documents is the term,
    not the beginning.  A beginning is a stem only if what it adds to its longer
    forms found here is in no clean document; if not, longer ones may be.
    """
    stems = {t: (a, c) for t, kind, a, c in found if kind == STEM}
    words = {t: (a, c) for t, kind, a, c in found if kind == EXACT}
    both = {**words, **stems}   # a stem's documents hold it as a word or as the start of one
    main: dict[str, str] = {}   # the word that reaches most for a beginning
    longer = Counter()          # clean documents of the next longer forms
    for t in sorted(words, key=lambda t: (words[t][0], t)):
        main.update((t[:n], t) for n in range(1, len(t) + 1))
    for t, (_, c) in both.items():
        if len(t) <= STEM_CHARS[-1] + 1:
            longer[t[:-1]] += c
        else:
            longer[t[:STEM_CHARS[-1]]] += c
    chosen: list[tuple[str, int, float]] = []
    taken: dict[str, int] = {}

    def covered(text: str) -> bool:
        fuzzy = len(text) > FUZZY_CHARS and taken.get(text[:-1]) == EXACT
        return text in taken or fuzzy or any(taken.get(text[:n]) == STEM for n in range(1, len(text)))

    def adds_nothing(stem: str) -> bool:  # a longer one reached as many
        return any(k == STEM and t.startswith(stem) for t, k in taken.items())

    for text, (n, _) in sorted(both.items(), key=lambda x: (-x[1][0], -len(x[0]), x[0])):
        word = main.get(text)
        if word and words[word][0] >= 0.5 * n:
            text, kind, (a, c) = word, EXACT, words[word]
        else:
            kind, (a, c) = STEM, both[text]
            if c > longer[text] + words.get(text, (0, 0))[1] or adds_nothing(text):
                continue
        if covered(text):
            continue
        weight = np.log((a + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1))
        chosen.append((text, kind, float(weight)))
        taken[text] = kind
        if len(chosen) == TERMS:
            break
    return chosen


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> tuple[np.ndarray, float]:
    """Newton steps; returns coefficients and intercept."""
    z = np.c_[x, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z / len(z) + ridge * np.eye(z.shape[1])
        w = w + np.clip(np.linalg.solve(hess, z.T @ (y - p) / len(z) - ridge * w), -2, 2)
    return w[:-1], float(w[-1])


def fit(df: DataFrame, labels: DataFrame, learn: Column, text_col: str = "text", id_col: str = "doc_id",
        label_col: str = "toxic", most: int = SAMPLE_ROWS) -> Model:
    """Lexicon, automaton and logistic weights from the labelled rows where ``learn`` holds."""
    chosen = labelled_sample(df, labels, learn, text_col, id_col, label_col, most).persist()
    n = {r[0]: r[1] for r in chosen.groupBy("label").agg(F.count(F.lit(1))).collect()}
    if len(n) < 2:
        chosen.unpersist()
        return Model()
    least = max(LEAST_DOCS, LEAST_SHARE * n[1])
    found = term_counts(chosen).where(
        (F.col("toxic") >= least) & (F.col("clean") / F.lit(n[0]) <= 0.02 * F.col("toxic") / F.lit(n[1])))
    top = found.orderBy(F.desc("toxic"), "term", "kind").limit(50 * TERMS).collect()
    model = Model(choose_terms([tuple(r) for r in top], n[1], n[0]))
    if model.terms:
        model.automaton = build(model.terms)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            x, _ = describe(shared.value, strings(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("label"), *(pa.array(c) for c in x.T)],
                                             ["label", *FEATURES])

    got = map_batches(chosen.select("label", "text"), step,
                      "label int, " + ", ".join(f"{c} double" for c in FEATURES)).toPandas()
    chosen.unpersist()
    x = got[FEATURES].to_numpy()
    model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    model.coef, model.intercept = fit_logistic((x - model.mean) / model.scale, got["label"].to_numpy(dtype=float))
    return model


def scores(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    x, hits = describe(model, texts)
    if model.coef is None:
        return np.zeros(len(texts)), hits
    z = (x - model.mean) / model.scale @ model.coef + model.intercept
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), hits


def score(df: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Rows (*carry, score, predicted, n_hits) for every row of ``df``."""
    carry = list(carry or [])
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*(df.schema[c] for c in carry), StructField("score", DoubleType()),
                         StructField("predicted", IntegerType()), StructField("n_hits", LongType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, SLICE_BYTES):
            p, hits = scores(shared.value, strings(batch.column(text_col)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carry), pa.array(p), pa.array((p >= 0.5).astype(np.int32)),
                 pa.array(hits)], schema.names)

    return map_batches(df.select(*dict.fromkeys([*carry, text_col])), step, schema)
