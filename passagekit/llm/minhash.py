"""Near-duplicate documents by MinHash with tensored banding.

Instead of one independent band per table, two small collections of ``HALVES``
half-bands are computed (``WIDTH`` minimum hashes each), and every pair of a
left and a right half-band is the key of one table: HALVES^2 tables from
2 * HALVES * WIDTH minimum hashes.  Two documents with similarity J meet in some
table unless all left or all right half-bands differ; at J = 0.85 that is at
most 2 * (1 - 0.85^4)^16, about 15 in a million links, and links of a component
back each other up.

Documents with equal shingle sets form one class, so copies cost one row.  A
half-band value that only one class has can open no table, so most classes make
no table key at all.  Links are confirmed on full sets, in two rounds:

1. In each table every class is compared with the smallest and the largest
   class there; confirmed pairs form components.  This settles groups of copies
   that are close to each other, with a few comparisons per class.
2. Tables that still hold several components join these to clusters.  A cluster is cut into blocks of bounded size, and
   each pair of blocks is compared in one task by counting common shingles for
   all pairs at once; only pairs of different components count, so the blocks of
   the cluster's main component are not compared with each other.  A task
   returns at most one link per component it holds, so no pair of candidates is
   dropped and none becomes a row.

Shingles are 64-bit hashes of five consecutive words (a 128-bit digest of the
sorted set names a class).

Defined cases: a NULL or empty text, or one without words, has no shingle, is its
own component and is kept; fewer than five words form one shingle; repeated rows
and ties fall in one class, component_id is the smallest id in the component
(NULL ids are ignored unless there is no other); rows that repeat the smallest
id are all kept; an empty table gives an empty result; other columns are not
touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from passagekit.llm.common import map_batches, slices, strings
from passagekit.llm.common import settled as cut  # many short steps in a row
from passagekit.session import ship_package

SHINGLE = 5
PER_CENT = 85
HALVES = 16
WIDTH = 4
HASHES = 2 * HALVES * WIDTH
BITS_APART = 25  # of HASHES; more than that has a chance of about 1e-6 at the threshold
BLOCK_SHINGLES = 500_000
BLOCK_SETS = 2000
STRIP_CELLS = 1 << 20    # counts of common shingles held at once
EDGES_A_TASK = 200_000
ROWS_AT_ONCE = 100_000
RARE = 32
SLICE_BYTES = 4 << 20
COLUMNS_AT_ONCE = 4096
WORDS_KEPT = 200_000

_rng = np.random.default_rng(20)
POSITION = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
SCALE = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Distinct shingle hashes of whole texts; keeps the hashes of a bounded number of words."""

    def __init__(self) -> None:
        self.seen: dict[bytes, int] = {}

    def shingles(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "replace").lower().split()  # ASCII case and ASCII blanks only
        seen = self.seen
        if len(seen) > WORDS_KEPT:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter((seen[w] for w in words), dtype=np.uint64, count=len(words))
        n = max(1, len(h) - SHINGLE + 1) if len(h) else 0
        width = min(SHINGLE, len(h))
        total = np.full(n, width, dtype=np.uint64)
        for k in range(width):
            total += h[k:k + n] * POSITION[k]
        return np.unique(mixed(total))


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), COLUMNS_AT_ONCE):
        block = shingles[at:at + COLUMNS_AT_ONCE]
        np.minimum(least, (SCALE[:, None] * block + SHIFT[:, None]).min(1), out=least)
    return least


def half_bands(least: np.ndarray) -> np.ndarray:
    """2 * HALVES numbers: the left half-bands, then the right ones."""
    return mixed((mixed(least).reshape(-1, WIDTH) * POSITION[:WIDTH]).sum(1, dtype=np.uint64)).view(np.int64)


def sketch(least: np.ndarray) -> tuple[int, int]:
    """One bit of every minimum hash, in two longs."""
    bits = np.packbits((mixed(least) & np.uint64(1)).astype(np.uint8))
    words = np.frombuffer(bits.tobytes().ljust(16, b"\0"), dtype="<i8")
    return int(words[0]), int(words[1])


def signatures(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Rows (id, text_hash, n_shingles, set_key, halves, bits0, bits1) of every text."""
    schema = StructType([
        StructField("id", df.schema[id_col].dataType), StructField("text_hash", LongType()),
        StructField("n_shingles", LongType()),
        StructField("set_key", BinaryType()), StructField("halves", ArrayType(LongType())),
        StructField("bits0", LongType()), StructField("bits1", LongType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in slices(batches, "text", SLICE_BYTES):
            size, key, halves, bits = [], [], [], []
            for text in strings(batch.column("text")):
                own = shingler.shingles(text)
                least = min_hashes(own)
                size.append(len(own))
                key.append(xxhash.xxh3_128_digest(own.tobytes()))
                halves.append(half_bands(least))
                bits.append(sketch(least))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), pa.array(size, pa.int64()), pa.array(key, pa.binary()),
                 pa.ListArray.from_arrays(np.arange(len(size) + 1, dtype=np.int32) * 2 * HALVES,
                                          np.concatenate(halves)),
                 *(pa.array(b, pa.int64()) for b in zip(*bits))], schema.names)

    return map_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                                 F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash")), step, schema)


def close_enough(a: str, b: str) -> Column:
    """Sizes and sketches of two classes allow a similarity at the threshold."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    apart = sum(F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in ("bits0", "bits1"))
    return (small * 100 >= large * PER_CENT) & (apart <= BITS_APART)


def table_keys(classes: DataFrame) -> DataFrame:
    """Rows (key, class) of the tables in which a class has company: key, me (cid, n, bits)."""
    halves = classes.select("cid", F.posexplode("halves").alias("slot", "value"))
    shared = halves.groupBy("slot", "value").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).where(
        "low < high").select("slot", "value")
    alive = halves.join(shared, ["slot", "value"]).groupBy("cid").agg(
        F.collect_list(F.struct("slot", "value")).alias("own"))  # 2 * HALVES at most
    left = F.filter("own", lambda x: x["slot"] < HALVES)
    right = F.filter("own", lambda x: x["slot"] >= HALVES)
    crossed = alive.select("cid", F.explode(left).alias("l"), right.alias("rights")).select(
        "cid", "l", F.explode("rights").alias("r"))
    keys = crossed.select(F.xxhash64("l.slot", "l.value", "r.slot", "r.value").alias("key"), "cid")
    company = keys.groupBy("key").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).where("low < high")
    return keys.join(company, "key")


def full_sets(docs: DataFrame, wanted: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Rows (cid, shingles) of the wanted classes (cid, at, set_key): hashes as bytes, sorted.

    A text is found by id and hash: rows that share an id (or have none) do not meet each other's classes.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    named = wanted.select("cid", "set_key", F.col("at.id").alias("of_id"), F.col("at.text_hash").alias("of_hash"))
    found = rows.join(named, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("hash") == F.col("of_hash"))).select(
        "cid", "set_key", "text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in slices(batches, "text", SLICE_BYTES):
            sets = [shingler.shingles(t).tobytes() for t in strings(batch.column("text"))]
            same = [xxhash.xxh3_128_digest(s) == k for s, k in zip(sets, batch.column("set_key").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(sets, pa.binary())],
                                             ["cid", "shingles"]).filter(pa.array(same))

    return map_batches(found, step, "cid long, shingles binary").dropDuplicates(["cid"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    both = (pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb")), "b"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= PER_CENT * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(both.select("a", "b", "sa", "sb"), step, "a long, b long")


def forests(edges: DataFrame, parts: int) -> DataFrame:
    """Edges (hi, lo) of every partition joined by its own union-find: each vertex with the partition's smallest
    one connected to it.  One entry a vertex of the partition is held in memory."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(v: int) -> int:
            while (w := up.get(v, v)) != v:
                up[v] = up.get(w, w)
                v = w
            return v

        for batch in batches:
            for x, y in zip(batch.column("hi").to_pylist(), batch.column("lo").to_pylist()):
                p, q = root(x), root(y)
                if p != q:
                    up[max(p, q)] = min(p, q)
        vertices = list(up)
        for a in range(0, len(vertices), ROWS_AT_ONCE):
            part = vertices[a:a + ROWS_AT_ONCE]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int64()), pa.array([root(v) for v in part], pa.int64())], ["hi", "lo"])

    return map_batches(edges.repartition(parts, "hi"), step, "hi long, lo long")


def components(edges: DataFrame) -> DataFrame:
    """Rows (v, label): the smallest vertex reachable.  ``edges`` (a, b) is stored.

    Rounds of three steps, the same for graphs of every size: partitions of about
    ``EDGES_A_TASK`` edges are joined by a union-find of their own; every edge then
    moves to the least neighbour of its smaller end; and all smaller neighbours of a
    vertex are tied to the least of them.  The rounds end when all edges lead from a
    vertex without another edge to one that has no smaller neighbour.
    """
    parts = max(1, -(-edges.count() // EDGES_A_TASK))
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    while True:
        # the forests of a partition do not depend on the order of its rows, so they may run again for the join
        joined = forests(now, parts)
        below = joined.groupBy("hi").agg(F.min("lo").alias("below")).withColumnRenamed("hi", "lo")
        moved = joined.join(below, "lo", "left").select(
            "hi", F.coalesce("below", "lo").alias("lo"), F.col("below").isNotNull().alias("open"))
        tied = cut(moved.withColumn("low", F.min("lo").over(Window.partitionBy("hi"))))
        if not tied.where("open OR lo <> low").head(1):
            return tied.select(F.col("hi").alias("v"), F.col("lo").alias("label")).union(
                tied.select("lo", "lo").distinct())
        now = tied.select(F.explode(F.array(F.struct("hi", F.col("low").alias("lo")),
                                            F.struct(F.col("lo").alias("hi"), F.col("low").alias("lo")))).alias("e")
                          ).select("e.hi", "e.lo").where("hi > lo")


def common_strips(own: np.ndarray, shingle: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Common shingles of all pairs of ``n`` sets, from (set, shingle) entries, in strips: first set, counts.

    A row has the counts of its set with all later ones.
    """
    order = np.argsort(shingle, kind="stable")
    own, shingle = own[order], shingle[order]
    first = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
    times = np.diff(np.r_[first, len(shingle)])
    few = {}
    for t in range(2, RARE + 1):  # shingles in a few sets: their pairs of sets, one by one
        at = first[times == t]
        if len(at):
            few[t] = np.sort(own[at[:, None] + np.arange(t)], axis=1).astype(np.int64)
    often = np.flatnonzero(times > RARE)
    height = max(1, STRIP_CELLS // max(1, n))
    for top in range(0, n, height):
        rows = min(height, n - top)
        common = np.zeros(rows * n, dtype=np.int32)
        for t, holders in few.items():
            for a in range(t - 1):
                mine = holders[(holders[:, a] >= top) & (holders[:, a] < top + rows)]
                np.add.at(common, ((mine[:, a, None] - top) * n + mine[:, a + 1:]).ravel(), 1)
        common = common.reshape(rows, n)
        for a in range(0, len(often), 2048):  # shingles in many sets: as a matrix product
            part = often[a:a + 2048]
            held = np.zeros((n, len(part)), dtype=np.float32)
            size = times[part]
            entry = np.repeat(first[part] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            held[own[entry], np.repeat(np.arange(len(part)), size)] = 1
            common += np.triu(held[top:top + rows] @ held.T, top + 1).astype(np.int32)
        yield top, common


def common_counts(own: np.ndarray, shingle: np.ndarray, n: int) -> np.ndarray:
    """Number of common shingles of all pairs of ``n`` sets, in one matrix."""
    return np.concatenate([np.zeros((0, n), dtype=np.int32), *(c for _, c in common_strips(own, shingle, n))])


def joining_links(cid: np.ndarray, label: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between sets of different components, as few as join what can be joined."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    up: dict[int, int] = {}

    def root(v: int) -> int:
        while up.get(v, v) != v:
            up[v] = up.get(up[v], up[v])
            v = up[v]
        return v

    out = []
    for top, common in common_strips(np.repeat(np.arange(n), size), np.concatenate(sets), n):
        a, b = np.nonzero(common)
        both = common[a, b].astype(np.int64)
        a = a + top
        hit = (100 * both >= PER_CENT * (size[a] + size[b] - both)) & (label[a] != label[b])
        a, b = a[hit], b[hit]
        _, one = np.unique(np.column_stack([label[a], label[b]]), axis=0, return_index=True)
        for x, y in zip(a[one].tolist(), b[one].tolist()):
            p, q = root(int(label[x])), root(int(label[y]))
            if p != q:
                up[max(p, q)] = min(p, q)
                out.append((int(cid[x]), int(cid[y])))
    return out


def links_in_clusters(placed: DataFrame, docs: DataFrame, classes: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Links (a, b) between the components of each cluster; ``placed``: (cid, label, cluster, n)."""
    import pandas as pd

    ship_package(docs.sparkSession)
    parts = placed.groupBy("cluster", "label").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("sets"))
    # the component with the most shingles is the cluster's main one
    main = parts.groupBy("cluster").agg(F.max(F.struct("total", "label", "sets")).alias("top"),
                                        F.sum("total").alias("all"), F.sum("sets").alias("all_sets"))

    def blocks_for(shingles: Column, sets: Column) -> Column:
        return F.greatest(F.ceil(shingles / BLOCK_SHINGLES), F.ceil(sets / BLOCK_SETS)).cast("int")

    blocks = main.select(
        "cluster", F.col("top.label").alias("main"),
        blocks_for(F.col("all") - F.col("top.total"), F.col("all_sets") - F.col("top.sets")).alias("others"),
        blocks_for(F.col("top.total"), F.col("top.sets")).alias("mains"))
    rows = placed.join(blocks, "cluster").withColumn("is_main", F.col("label") == F.col("main"))
    spread = F.xxhash64("cid")
    block = F.when(F.col("is_main"), F.col("others") + F.pmod(spread, F.col("mains"))).otherwise(
        F.pmod(spread, F.col("others"))).cast("int")
    # blocks of other components meet every block, blocks of the main one only those of others
    meets = F.when(F.col("is_main"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(
        F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1))
    cells = rows.withColumn("block", block).select(
        "cluster", "cid", "label", "block", F.explode(meets).alias("other")).select(
        "cluster", "cid", "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    wanted = placed.select("cid").join(classes.select("cid", "at", "set_key"), "cid")
    sets = cut(full_sets(docs, wanted, text_col, id_col))

    def compare(own: pd.DataFrame) -> pd.DataFrame:
        own = own.drop_duplicates("cid")
        found = joining_links(own["cid"].to_numpy(), own["label"].to_numpy(),
                              [np.frombuffer(s, dtype=np.uint64) for s in own["shingles"]])
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return cells.join(sets, "cid").groupBy("cluster", "i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (id, n_shingles, component_id, kept, text_hash), one per input row.

    ``text_hash`` (xxhash64 of the text) tells rows apart that share an id.
    """
    rows = cut(signatures(df, text_col, id_col))
    classes = cut(rows.where("n_shingles > 0").groupBy("set_key").agg(
        F.min("id").alias("rep"), F.min(F.struct("id", "text_hash")).alias("at"), F.first("n_shingles").alias("n"), F.first("halves").alias("halves"),
        F.first("bits0").alias("bits0"), F.first("bits1").alias("bits1"))).withColumn("cid", F.monotonically_increasing_id())
    tables = cut(table_keys(classes))  # key, cid, low, high
    facts = classes.select("cid", "n", "bits0", "bits1")

    # round 1: every class with the smallest and the largest of its tables
    stars = tables.select(F.col("low").alias("a"), F.col("cid").alias("b")).union(
        tables.select(F.col("cid"), F.col("high"))).where("a < b").distinct()
    near = cut(stars.join(facts.alias("x"), F.col("a") == F.col("x.cid")).join(
        facts.alias("y"), F.col("b") == F.col("y.cid")).where(close_enough("x", "y")).select("a", "b"))
    wanted = near.select(F.col("a").alias("cid")).union(near.select("b")).distinct().join(
        classes.select("cid", "at", "set_key"), "cid")
    sets = cut(full_sets(df, wanted, text_col, id_col))
    # the smallest partner of every class first; then only pairs that these links do not connect yet
    firsts = near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    first_links = cut(confirmed(firsts, sets))
    # two steps up the confirmed partners: classes that meet there are connected already
    up = first_links.select(F.col("b").alias("v"), F.col("a").alias("up"))
    over = up.select(F.col("v").alias("up"), F.col("up").alias("over"))
    tops = up.join(over, "up", "left").select("v", F.coalesce("over", "up").alias("top"))
    rest = near.join(firsts, ["a", "b"], "left_anti").join(
        tops.select(F.col("v").alias("a"), F.col("top").alias("ta")), "a", "left").join(
        tops.select(F.col("v").alias("b"), F.col("top").alias("tb")), "b", "left").where(
        F.coalesce("ta", "a") != F.coalesce("tb", "b")).select("a", "b")
    labels = components(cut(first_links.union(confirmed(cut(rest), sets))))

    # round 2: clusters of components connected by tables that hold several of them
    placed = tables.select("key", "cid").join(labels.withColumnRenamed("v", "cid"), "cid", "left").withColumn(
        "label", F.coalesce("label", "cid"))
    several = placed.groupBy("key").agg(F.min("label").alias("low_label"), F.max("label").alias("high_label")).where(
        "low_label < high_label").select("key", "low_label")
    mixed_rows = cut(placed.join(several, "key").select("cid", "label", "low_label").distinct())
    merged = None
    if mixed_rows.head(1):
        clusters = components(cut(mixed_rows.where("low_label < label").select(
            F.col("low_label").alias("a"), F.col("label").alias("b")).distinct()))
        members = cut(mixed_rows.select("cid", "label").distinct().join(
            clusters.select(F.col("v").alias("label"), F.col("label").alias("cluster")), "label").join(
            facts.select("cid", "n"), "cid"))
        more = cut(links_in_clusters(members, df, classes, text_col, id_col))
        # the new links join components: a graph of the components alone
        own = members.select("cid", "label")
        joined = more.join(own.select(F.col("cid").alias("a"), F.col("label").alias("x")), "a").join(
            own.select(F.col("cid").alias("b"), F.col("label").alias("y")), "b")
        merged = components(cut(joined.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()))
        merged = merged.select(F.col("v").alias("label"), F.col("label").alias("top"))

    named = classes.join(labels.withColumnRenamed("v", "cid"), "cid", "left").withColumn(
        "label", F.coalesce("label", "cid"))
    if merged is not None:
        named = named.join(merged, "label", "left").withColumn("label", F.coalesce("top", "label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_set = named.join(least, "label").select("set_key", "component_id")
    some = F.col("n_shingles") > 0
    out = rows.select("id", "text_hash", "n_shingles", F.when(some, F.col("set_key")).alias("set_key")).join(
        of_set, "set_key", "left").withColumn(
        "component_id", F.when(some, F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash")
