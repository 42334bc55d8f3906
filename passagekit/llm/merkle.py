"""Merkle manifest of a dataset, with leaf coordinates from bitmap ranks.

Every group (of documents: a language) keeps the ids of its leaves as a bitmap:
only the 64-bit words that hold an id, merged map-side with ``bit_or``, and
above them a popcount directory of four levels (words, 2^16 ids, 2^32 ids,
2^48 ids).  The place of a leaf in its group is the directory's count of
everything before its word plus the set bits below its own: nothing is sorted.
A directory entry has at most 65,537 neighbours, so its running count is a
bounded window whatever the ids are.

Nodes go up in keyed slot arrays: one aggregate on (tree, place / 512) fills an
array of 512 slots, three levels of eight are hashed inside the row, and the
next aggregate sees 1/512 of the nodes.  The paths come down the same arrays.

Defined cases: a NULL id comes before all others, a NULL group first; leaves of
one id are ordered by their hash, so repeated rows change nothing but their
number (words with repeated ids take their places from a global order, which a
third of all rows may share); a lone leaf is its own subroot and a lone subroot
the root, with an empty path; an empty table gives no rows; other columns are
ignored unless carried (``carry``: columns of types that can be ordered).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagekit.functions.arrays import explode_rows
from passagekit.llm.common import cut
from passagekit.operators.curate import dense_index, group_positions

FAN = 8
BLOCK_BITS = 9  # three levels of eight
PATH = "array<struct<left:string,right:string>>"
#: bits of the word number below each directory level: 1024 words, then 65,536 entries each
LEVELS = (10, 26, 42)
NO_ID = -(1 << 57) - 1  # word of the NULL ids, below every other


def prefixed(value: Column) -> Column:
    """``-`` for NULL, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(prefixed, values)).cast("binary"), 256)


def join_hashes(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def digest(hashes: Column) -> Column:
    return F.sha2(join_hashes(hashes).cast("binary"), 256)


def parents(level: Column) -> Column:
    """The hashes of every eight consecutive ones (the last run may be shorter)."""
    runs = F.sequence(F.lit(0), ((F.size(level) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda r: digest(F.slice(level, r * FAN + 1, FAN)))


def siblings(level: Column, at: Column) -> Column:
    """The others of the run of eight around place ``at``, left and right of it."""
    nth = at % FAN
    return F.struct(join_hashes(F.slice(level, at - nth + 1, nth)).alias("left"),
                    join_hashes(F.slice(level, at + 2, FAN - 1 - nth)).alias("right"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, leaf, lambda node, p: F.sha2(
        F.concat(p["left"], node, p["right"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return digest(F.transform(path, lambda p: F.concat(p["left"], p["right"])))


def popcount_directory(words: DataFrame) -> DataFrame:
    """Adds ``_before`` (ids of the tree before the word) and ``_n`` (all ids of the tree)."""
    def running(rows: DataFrame, parent: str, key: str) -> DataFrame:
        w = Window.partitionBy("_tree", parent).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("_here", F.coalesce(F.sum("_count").over(w), F.lit(0)))

    tables, rows, key = [], words.withColumn("_k0", F.col("_word")), "_k0"
    for depth, shift in enumerate(LEVELS, 1):
        rows = rows.withColumn(f"_k{depth}", F.shiftright("_word", shift))
        tables.append(running(rows, f"_k{depth}", key))
        key = f"_k{depth}"
        rows = rows.groupBy("_tree", key).agg(F.sum("_count").alias("_count"),
                                              F.min("_word").alias("_word"))
    whole = Window.partitionBy("_tree")
    placed = running(rows.withColumn("_all", F.lit(0)), "_all", key).select(
        "_tree", key, F.col("_here").alias("_before"), F.sum("_count").over(whole).alias("_n"))
    for depth in range(len(LEVELS), 0, -1):
        rows = tables[depth - 1].join(placed, ["_tree", f"_k{depth}"]).withColumn(
            "_before", F.col("_before") + F.col("_here"))
        placed = rows if depth == 1 else rows.select("_tree", f"_k{depth - 1}", "_before", "_n")
    return placed.select("_tree", "_word", "_bits", "_count", "_before", "_n")


def coordinates(leaves: DataFrame, keep: list[str]) -> DataFrame:
    """Place (from 0) of every leaf in its tree, and the tree's number of leaves.

    ``leaves``: _tree, _id, _leaf and ``keep``.
    """
    leaves = leaves.withColumn("_word", F.coalesce(F.shiftright("_id", 6), F.lit(NO_ID))).withColumn(
        "_bit", F.coalesce(F.col("_id").bitwiseAND(F.lit(63)), F.lit(0)).cast("int"))
    words = cut(leaves.groupBy("_tree", "_word").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))).alias("_bits"),
        F.count(F.lit(1)).alias("_count")))
    found = leaves.join(popcount_directory(words), ["_tree", "_word"])
    single = F.col("_count") == F.bit_count("_bits")
    below = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), F.col("_bit")))
    alone = found.where(single).withColumn(
        "_pos", F.col("_before") + F.bit_count(F.col("_bits").bitwiseAND(below)))
    crowded = found.where(~single).withColumn("_key", F.concat("_tree", F.lit("|"), F.col("_word").cast("string")))
    placed = group_positions(crowded, "_key", ["_id", "_leaf"], "_nth").withColumn(
        "_pos", F.col("_before") + F.col("_nth") - 1)
    columns = ["_tree", "_pos", "_n", "_leaf", *keep]
    return alone.select(*columns).unionByName(placed.select(*columns))


def grow(nodes: DataFrame, keep: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of 512 nodes, level group by level group, and the top (_tree, _top) of every tree.

    ``nodes``: _tree, _pos, _n (nodes of the tree at this level), _leaf and ``keep``.
    """
    chunks, tops, most = [], [], None
    while most is None or most > 1:
        slot = F.col("_pos").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
        blocks = nodes.groupBy("_tree", F.shiftright("_pos", BLOCK_BITS).alias("_block")).agg(
            F.sort_array(F.collect_list(F.struct(slot.alias("_slot"), "_leaf", *keep))).alias("_slots"),
            F.max("_n").alias("_n"))
        hashes = F.col("_slots._leaf")
        blocks = blocks.withColumn("_l1", F.when(F.col("_n") > 1, parents(hashes)))
        blocks = blocks.withColumn("_l2", F.when(F.col("_n") > FAN, parents(F.col("_l1"))))
        blocks = blocks.withColumn("_l3", F.when(F.col("_n") > FAN * FAN, parents(F.col("_l2"))))
        blocks = cut(blocks.withColumn("_top", F.coalesce("_l3", "_l2", "_l1", hashes)[0]).withColumn(
            "_left", F.shiftright(F.col("_n") + (1 << BLOCK_BITS) - 1, BLOCK_BITS)).drop("_l3"))
        chunks.append(blocks)
        tops.append(blocks.where("_left = 1").select("_tree", "_top"))
        most = blocks.agg(F.max("_left")).first()[0] or 0
        nodes = blocks.where("_left > 1").select(
            "_tree", F.col("_block").alias("_pos"), F.col("_left").alias("_n"), F.col("_top").alias("_leaf"))
        keep = []
    return chunks, reduce(DataFrame.unionByName, tops)


def descend(chunks: list[DataFrame], ends: DataFrame, keep: list[str]) -> DataFrame:
    """Every first-level node with its path: _tree, _leaf, ``keep``, _path and the columns of ``ends``.

    ``ends``: _tree, _above (the path above the tree's top) and columns that all nodes of a tree get.
    """
    known = [c for c in ends.columns if c not in ("_tree", "_above")]
    over = None
    for depth in reversed(range(len(chunks))):
        blocks = chunks[depth]
        placed = blocks.where("_left = 1").join(ends, "_tree")
        if over is not None:
            placed = placed.unionByName(blocks.where("_left > 1").join(over, ["_tree", "_block"]))
        size = F.size("_slots")
        runs = F.transform(F.sequence(F.lit(0), ((size - 1) / FAN).cast("int")), lambda r: F.struct(
            r.alias("run"), F.slice("_slots", r * FAN + 1, FAN).alias("members")))
        placed = explode_rows(placed, ["_tree", "_block", "_n", "_l1", "_l2", "_above", *known], runs, ["_run"])
        at = F.col("_run.run")
        upper = F.array(F.when(F.col("_n") > FAN, siblings(F.col("_l1"), at)),
                        F.when(F.col("_n") > FAN * FAN, siblings(F.col("_l2"), (at / FAN).cast("int"))))
        placed = placed.select(
            "_tree", "_block", "_n", at.alias("_run"), F.col("_run.members").alias("_members"),
            F.concat(F.filter(upper, lambda p: p.isNotNull()), "_above").alias("_above"), *known)
        hashes = F.col("_members._leaf")
        nodes = explode_rows(placed, ["_tree", "_block", "_n", "_run", "_above", "_members", *known],
                             F.col("_members"), ["_nth", "_node"])
        own = F.filter(F.array(F.when(F.col("_n") > 1, siblings(hashes, F.col("_nth")))), lambda p: p.isNotNull())
        path = F.concat(own, "_above")
        if depth:
            over = nodes.select(
                "_tree", (F.shiftleft("_block", BLOCK_BITS) + F.col("_run") * FAN + F.col("_nth")).alias("_block"),
                path.alias("_above"), *known)
        else:
            return nodes.select("_tree", "_node._leaf", *(f"_node.{c}" for c in keep), path.alias("_path"), *known)


def manifest(leaves: DataFrame, id_col: str = "doc_id", group_col: str = "lang", leaf_col: str = "leaf",
             carry: list[str] | None = None) -> DataFrame:
    """Rows (id, *carry, leaf, subroot, root, path): the Merkle tree of each group, and the tree of the groups.

    ``path`` lists, from the leaf to the root, the hashes left and right of the node in its run of eight.
    """
    carry = carry or []
    inner = [f"_c{k}" for k in range(len(carry) + 1)]
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    rows = cut(leaves.select(
        tree.alias("_tree"), F.col(id_col).cast("long").alias("_id"), F.col(leaf_col).alias("_leaf"),
        *(F.col(c).alias(i) for c, i in zip([id_col, *carry], inner))))
    chunks, tops = grow(coordinates(rows, inner), inner)

    order = dense_index(tops.select("_tree"), "_tree", "_rank")
    groups = tops.join(order, "_tree").select(
        F.lit("").alias("_tree"), (F.col("_rank") - 1).alias("_pos"),
        order.select(F.count(F.lit(1))).scalar().alias("_n"), F.col("_top").alias("_leaf"),
        F.col("_tree").alias("_group"))
    group_chunks, roots = grow(groups, ["_group"])
    nothing = F.array().cast(PATH)
    subroots = descend(group_chunks, roots.select("_tree", F.col("_top").alias("_root"), nothing.alias("_above")),
                       ["_group"])
    ends = subroots.select(F.col("_group").alias("_tree"), F.col("_leaf").alias("_subroot"), "_root",
                           F.col("_path").alias("_above"))
    out = descend(chunks, ends, inner)
    return out.select(*(F.col(i).alias(c) for c, i in zip([id_col, *carry], inner)), F.col("_leaf").alias(leaf_col),
                      F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), F.col("_path").alias("path"))
