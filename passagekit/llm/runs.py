"""Runs (maximal periodicities) of word sequences, from suffix trees.

A run is a stretch of consecutive words with smallest period q, at least
``max(12, 2 * q)`` words long, that no neighbouring word extends.

Every run lies in words covered by repeated 6-word grams (its two copies, q
words apart, overlap or touch and are at least 6 words long), so other words
only separate: the covered stretches of many documents are laid side by side,
each closed by a symbol of its own.  Ukkonen's algorithm builds the suffix
trees of that sequence and of its reversal; an Euler tour with a sparse table
answers the longest common extension of two places in constant time (the
lowest common ancestor of two leaves).  The candidates are the longest Lyndon
words at every place under both orders of the symbols (one of them is a root of
every run); they are extended to both sides and kept if twice as long as the root.

Defined cases: a NULL or empty text has no words and no runs; repeated rows
each give a row; an empty table gives no rows; other columns are ignored unless
carried.  A document is one row: memory grows with the longest stretch that
repeats within a document (about 2 KB a word of it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from passagekit.llm.common import map_batches, slices

LEAST = 12
GRAM = 6
#: bytes of text that are laid side by side at most (one document at least)
SLICE_BYTES = 1 << 21
#: symbols of one pair of trees (one stretch at least)
TREE_SYMBOLS = 1 << 16

RUNS = ArrayType(StructType([StructField("start", LongType()), StructField("length", LongType()),
                             StructField("period", LongType())]))


def suffix_tree(text: list[int]) -> tuple[dict[int, int], list[int], list[int]]:
    """Ukkonen's tree of a sequence whose last symbol occurs once.

    Returns (children, start, end): node 0 is the root, the edge into node v is
    ``text[start[v]:end[v]]``, and ``children[node * width + symbol]`` is a node
    (``width`` = largest symbol + 1).
    """
    n, width = len(text), max(text) + 1
    children: dict[int, int] = {}
    start, end, link = [0], [0], [0]
    node = edge = length = waiting = 0
    for at in range(n):
        symbol = text[at]
        waiting += 1
        last = 0
        while waiting:
            if not length:
                edge = at
            slot = node * width + text[edge]
            child = children.get(slot)
            if child is None:
                children[slot] = len(start)
                start.append(at)
                end.append(n)
                link.append(0)
                if last:
                    link[last] = node
                    last = 0
            else:
                first = start[child]
                size = min(end[child], at + 1) - first
                if length >= size:  # walk down
                    edge += size
                    length -= size
                    node = child
                    continue
                if text[first + length] == symbol:
                    length += 1
                    if last:
                        link[last] = node
                    break
                split = len(start)
                children[slot] = split
                start += (first, at)
                end += (first + length, n)
                link += (0, 0)
                children[split * width + symbol] = split + 1
                start[child] = first + length
                children[split * width + text[first + length]] = child
                if last:
                    link[last] = split
                last = split
            waiting -= 1
            if node == 0 and length:
                length -= 1
                edge = at - waiting + 1
            elif node:
                node = link[node]
    return children, start, end


class Extensions:
    """Longest common extensions of the places of a sequence, and the order of its suffixes."""

    def __init__(self, text: list[int]):
        n, width = len(text), max(text) + 1
        children, start, end = suffix_tree(text)
        keys = np.fromiter(children.keys(), np.int64, len(children))
        nodes = np.fromiter(children.values(), np.int64, len(children))
        order = np.argsort(keys, kind="stable")  # by node, then by symbol
        nodes = nodes[order]
        first = np.searchsorted(keys[order] // width, np.arange(len(start) + 1)).tolist()
        edge = (np.array(end) - np.array(start)).tolist()
        below = nodes.tolist()
        # Euler tour of string depths: a node is met before, between and after its children
        tour, leaf_at, leaves = [0], [0] * n, []
        stack, nexts, depths = [0], [first[0]], [0]
        while stack:
            node, k, depth = stack[-1], nexts[-1], depths[-1]
            if k == first[node + 1]:
                stack.pop(), nexts.pop(), depths.pop()
                if depths:
                    tour.append(depths[-1])
                continue
            nexts[-1] = k + 1
            child = below[k]
            deep = depth + edge[child]
            if first[child] == first[child + 1]:
                leaves.append(n - deep)
                leaf_at[n - deep] = len(tour)
                tour += (deep, depth)
            else:
                tour.append(deep)
                stack.append(child)
                nexts.append(first[child])
                depths.append(deep)
        self.rank = np.empty(n, np.int64)
        self.rank[leaves] = np.arange(n)
        self.place = np.array(leaf_at, np.int64)
        self.table = [np.array(tour, np.int32)]
        half = 1
        while 2 * half <= len(tour):
            row = self.table[-1]
            self.table.append(np.minimum(row[:-half], row[half:]))
            half *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``a`` and ``b``."""
        left, right = np.minimum(self.place[a], self.place[b]), np.maximum(self.place[a], self.place[b]) + 1
        level = np.frexp((right - left).astype(np.float64))[1] - 1
        out = np.empty(len(left), np.int64)
        for k in np.unique(level):
            at = level == k
            row = self.table[k]
            out[at] = np.minimum(row[left[at]], row[right[at] - (1 << int(k))])
        return out


def next_smaller(rank: list[int]) -> list[int]:
    """For every place the next one of smaller rank (the length, if none)."""
    n = len(rank)
    out, stack = [n] * n, []
    for at, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = at
        stack.append(at)
    return out


def runs_of(text: np.ndarray) -> np.ndarray:
    """All runs (start, length, period) of a sequence whose last symbol occurs once."""
    n = len(text)
    ahead = Extensions(text.tolist())
    # the reversal is closed by a symbol of its own too
    back = Extensions([*text[::-1].tolist(), int(text.max()) + 1])
    at = np.arange(n)
    found = []
    for rank in (ahead.rank, n - 1 - ahead.rank):
        period = np.array(next_smaller(rank.tolist()), np.int64) - at
        start = at[at + period < n]
        period = period[start]
        forward = ahead.common(start, start + period)
        backward = np.zeros(len(start), np.int64)
        inner = start > 0
        backward[inner] = back.common(n - start[inner], n - (start[inner] + period[inner]))
        length = backward + period + forward
        keep = length >= np.maximum(LEAST, 2 * period)
        found.append(np.stack([start - backward, length, period], axis=1)[keep])
    return np.unique(np.concatenate(found), axis=0)


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of words covered by repeated grams, long enough to hold a run.

    Grams are compared by a hash: equal ones always agree, and a chance hit only lets more words in.
    """
    m = len(ids) - GRAM + 1
    if m < 2:
        return []
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    grams = np.zeros(m, np.uint64)
    for k in range(GRAM):
        grams = grams * np.uint64(0xBF58476D1CE4E5B9) + mixed[k:k + m]
    order = np.argsort(grams)
    same = grams[order[1:]] == grams[order[:-1]]
    repeated = np.zeros(m, bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    edges = np.zeros(len(ids) + 1, np.int64)
    hits = np.flatnonzero(repeated)
    np.add.at(edges, hits, 1)
    np.add.at(edges, hits + GRAM, -1)
    covered = np.concatenate([[0], (np.cumsum(edges[:-1]) > 0).astype(np.int8), [0]])
    change = np.flatnonzero(np.diff(covered))
    return [(a, b) for a, b in zip(change[::2].tolist(), change[1::2].tolist()) if b - a >= LEAST]


def runs_of_documents(documents: list[np.ndarray]) -> list[np.ndarray]:
    """Runs (start, length, period) of every document, by start, then period."""
    found: list[list[np.ndarray]] = [[] for _ in documents]
    waiting: list[tuple[int, int, np.ndarray]] = []

    def solve() -> None:
        sizes = [len(x) for *_, x in waiting]
        top = max(int(x.max()) for *_, x in waiting) + 1
        text = np.concatenate([np.append(x, top + k) for k, (*_, x) in enumerate(waiting)])
        begin = np.cumsum([0, *(s + 1 for s in sizes[:-1])])
        runs = runs_of(text)
        owner = np.searchsorted(begin, runs[:, 0], side="right") - 1
        for k in np.unique(owner).tolist():
            doc, a, _ = waiting[k]
            found[doc].append(runs[owner == k] + np.array([a - begin[k], 0, 0]))
        waiting.clear()

    held = 0
    for doc, ids in enumerate(documents):
        for a, b in stretches(ids):
            if held and held + b - a > TREE_SYMBOLS:
                solve()
                held = 0
            waiting.append((doc, a, ids[a:b]))
            held += b - a + 1
    if waiting:
        solve()
    out = []
    for parts in found:
        runs = np.concatenate(parts) if parts else np.empty((0, 3), np.int64)
        out.append(runs[np.lexsort((runs[:, 2], runs[:, 0]))])
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """The words without those that repeat a run's first period, joined by blanks."""
    if len(runs):
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
    return b" ".join(words).decode()


def find(columns: list[str], text_col: str):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, SLICE_BYTES):
            # bytes.split() cuts at \\x20 and \\x09-\\x0D, as the words are defined
            texts = [(x or "").encode().split() for x in batch.column(text_col).to_pylist()]
            known: dict[bytes, int] = {}
            found = runs_of_documents([
                np.array([known.setdefault(w, len(known)) for w in words], np.int64) for words in texts])
            flat = np.concatenate(found) if found else np.empty((0, 3), np.int64)
            offsets = np.cumsum([0, *map(len, found)])
            runs = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()),
                pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)],
                                           ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array([len(w) for w in texts], pa.int64()), runs,
                 pa.array([collapsed(w, r) for w, r in zip(texts, found)], pa.string())],
                [*columns, "n_words", "runs", "collapsed"])

    return step


def find_runs(df: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Rows (*carry, n_words, runs, collapsed): ``runs`` holds (start, length, period) by start, then period;
    ``collapsed`` is the text with every run cut to its first period, words joined by one blank."""
    columns = ["doc_id"] if carry is None else carry
    inner = [f"c{k}" for k in range(len(columns))]
    rows = df.select(df[text_col].alias("_text"), *(df[c].alias(i) for c, i in zip(columns, inner)))
    schema = StructType([*(StructField(i, df.schema[c].dataType) for c, i in zip(columns, inner)),
                         StructField("n_words", LongType()), StructField("runs", RUNS),
                         StructField("collapsed", StringType())])
    out = map_batches(rows, find(inner, "_text"), schema)
    return out.toDF(*columns, "n_words", "runs", "collapsed")
