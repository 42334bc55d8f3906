"""Packing token sequences by minimum bin slack.

Documents are encoded (``bpe``, the ids of the tokenizers library) and cut into
full windows and one remainder.  What is left to pack is
a multiset of lengths below the capacity: a histogram of at most ``capacity``
counters, whatever the size of the corpus.  The plan takes the longest remaining
length, finds by a bitset subset-sum dynamic programme the multiset of other
remaining lengths that fills the window closest to capacity, backtracks how
often each length is used, and repeats this pattern as long as the counts last;
every pattern uses up a length, so the plan has at most about ``capacity``
patterns.  Pieces find their place from (length, rank among that length): ranks
come from per-partition counters and a prefix sum of the per-partition
histograms, so no length -- however common -- is gathered in one task.

Defined cases: a NULL or empty text is one document that holds the end id only;
repeated rows are packed as often as they occur; other columns are not touched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagekit.llm.bpe import BpeEncoder, encoded, encoder_of
from passagekit.llm.common import cut, map_batches

CAPACITY = 4096
END_ID = 2


def best_fill(counts: np.ndarray, room: int) -> dict[int, int]:
    """Lengths and how often each is used, of a multiset whose sum is closest to ``room`` from below.

    ``counts[x]``: how many pieces of length x there are.  The bitset holds the
    reachable sums; a length joins in powers of two up to its count.  Longer
    lengths come first, and the search ends when ``room`` itself is reached.
    """
    target = 1 << room
    mask = (target << 1) - 1
    sums, steps = 1, []
    for length in (np.flatnonzero(counts[1:room + 1]) + 1)[::-1].tolist():
        left, part = min(int(counts[length]), room // length), 1
        while left:
            take = min(part, left)
            steps.append((length, take, sums))
            sums = (sums | sums << length * take) & mask
            left -= take
            part *= 2
            if sums & target:
                break
        if sums & target:
            break
    at, used = sums.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:  # the sum needs this step
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def plan_bins(histogram: np.ndarray, capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Patterns for a histogram of lengths (index = length, up to ``capacity``).

    One row per (pattern, length): ``length``, ``rank`` (first rank it takes of
    that length), ``times`` (uses in one window), ``bin`` (first window of the
    pattern), ``offset`` (in the window).  Rows are sorted by (length, rank).
    """
    counts = histogram.astype(np.int64).copy()
    taken = np.zeros_like(counts)
    rows, bins = [], 0
    longest = capacity
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            break
        counts[longest] -= 1
        use = best_fill(counts, capacity - longest)
        counts[longest] += 1
        use[longest] = use.get(longest, 0) + 1
        repeat = min(int(counts[x]) // n for x, n in use.items())
        offset = 0
        for x in sorted(use, reverse=True):
            rows.append((x, taken[x], use[x], bins, offset))
            offset += x * use[x]
            counts[x] -= use[x] * repeat
            taken[x] += use[x] * repeat
        bins += repeat
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return dict(zip(("length", "rank", "times", "bin", "offset"), table.T.copy()))


def place(plan: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these lengths and ranks."""
    wide = np.int64(1) << 44  # above any rank
    row = np.searchsorted(plan["length"] * wide + plan["rank"], length * wide + rank, side="right") - 1
    nth = rank - plan["rank"][row]
    times = plan["times"][row]
    return plan["bin"][row] + nth // times, plan["offset"][row] + nth % times * length


def pieces(df: DataFrame, spec: str, text_col: str, id_col: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of all documents with their rank among the pieces of their length in the partition."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(spec)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for ids, flat, length in encoded(batches, encoder_of(BpeEncoder, shared.value)):
            owner, start, size, crc, total, rank = [], [], [], [], [], []
            for k, own in enumerate(np.split(flat, np.cumsum(length)[:-1])):
                own = np.append(own, end_id).astype("<u4")
                for at in range(0, len(own), capacity):
                    piece = own[at:at + capacity]
                    owner.append(k)
                    start.append(at)
                    size.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(own))
                    rank.append(seen[len(piece)])
                    seen[len(piece)] += 1
            columns = [ids.take(pa.array(owner, pa.int32())), *(pa.array(x, pa.int64()) for x in (
                start, size, crc, total, rank)), pa.array([part] * len(owner), pa.int32())]
            yield pa.RecordBatch.from_arrays(
                columns, [id_col, "start", "length", "ids_crc32", "doc_tokens", "rank", "part"])

    return map_batches(df.select(id_col, text_col), step, f"{id_col} {kind}, start long, length long, "
                       "ids_crc32 long, doc_tokens long, rank long, part int")


def pack(df: DataFrame, spec: str, text_col: str = "text", id_col: str = "doc_id",
         capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document (its tokens, then ``end_id``) lies in exactly one
    piece; the pieces of a sequence are gapless from offset 0.
    """
    spark = df.sparkSession
    found = cut(pieces(df, spec, text_col, id_col, capacity, end_id))
    local = found.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part")
    first = local.withColumn("first", F.sum("n").over(before) - F.col("n")).select("length", "part", "first")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # capacity rows at most
        histogram[row["length"]] = row["n"]
    shared = spark.sparkContext.broadcast(plan_bins(histogram, capacity))
    ranked = found.join(first, ["length", "part"]).select(
        id_col, "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("first")).alias("rank"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = place(shared.value, *(
                batch.column(x).to_numpy(zero_copy_only=False) for x in ("length", "rank")))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(offset)],
                [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(ranked, step, f"{id_col} {kind}, start long, length long, ids_crc32 long, "
                       "doc_tokens long, sequence_id long, offset long")
