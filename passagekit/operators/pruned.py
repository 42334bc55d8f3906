"""Exact nearest neighbours that visit only the cells which can hold one.

The index is split into cells around pivots (index rows chosen by a hash of
their id; every row goes to its nearest pivot).  A cell knows how many rows it
has and how near and far from the pivot they lie, so the triangle inequality
bounds the distance of a query to all of its rows.

* Round 1 visits a query's nearest cells, as many as hold ``k`` rows: the
  k-th distance found there is an upper bound of the true one.
* Round 2 visits the other cells whose lower bound does not exceed that.

Cells are lined up along the main direction of their pivots.  Rows are cut into
blocks in that order and queries, by their home cell, too; a cell of any size
spreads over as many blocks as it fills.  A query travels once to every block of
rows that holds a cell it visits, with the list of these cells, and a block of
rows to every block of queries that asks for it: where the bounds leave out
nothing, each vector is sent as often as the grid of ``vectors.knn`` would send
it, not once per cell.  Pivots, cell bounds and cell sizes are the only things
collected: ``PIVOT_NUMBERS`` numbers and two rows per cell at most.

Vectors that are NULL or hold a NULL, NaN or infinite component take no part.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagekit.operators.vectors import (
    Q_BLOCK_NUMBERS, Q_LEAST_ROWS, X_BLOCK_NUMBERS, Nearest, _vectors, usable)
from passagekit.session import checkpoint_dir, ship_package

PIVOT_NUMBERS = 1 << 18
#: relative room for rounding in a bound; a bound is only used to leave cells out
ROUNDING = 1e-9
#: rows routed at once, queries of one matrix product
ROUTE_ROWS, Q_CELL_ROWS = 1024, 1024


def _to_pivots(v: pd.Series, pivots: np.ndarray) -> np.ndarray:
    x = np.stack(v.to_numpy()).astype(np.float64)
    d2 = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(d2, 0.0))


def _first_cells(dist: np.ndarray, sizes: np.ndarray, need: int) -> np.ndarray:
    """For each query the nearest cells that hold ``need`` rows together (a mask)."""
    order = np.argsort(dist, axis=1, kind="stable")
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    mask = np.zeros(dist.shape, bool)
    np.put_along_axis(mask, order, before < need, axis=1)
    return mask


def _line_up(pivots: np.ndarray) -> np.ndarray:
    """Place of every cell in the order along the main direction of the pivots."""
    centred = pivots - pivots.mean(axis=0)
    main = np.linalg.svd(centred, full_matrices=False)[2][0]
    place = np.empty(len(pivots), np.int64)
    place[np.argsort(centred @ main, kind="stable")] = np.arange(len(pivots))
    return place


def _spread(sizes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """First row number of every cell when its rows are numbered in the order of ``place``."""
    begin = np.empty(len(sizes), np.int64)
    order = np.argsort(place)
    begin[order] = np.cumsum(sizes[order]) - sizes[order]
    return begin


def _router(pivots: np.ndarray, sizes: np.ndarray, near: np.ndarray, far: np.ndarray, need: int, second: bool,
            begin: np.ndarray, rows: int):
    """Rows (q, v, home, bound, first, xb, cells, work): the blocks a query visits in the first or the
    second round, the cells it visits there, and (in one of its rows) its number of distances.
    ``first``: the cells of its first round."""
    scale = float(np.abs(pivots).max(initial=0.0)) + float(far.max(initial=0.0)) + 1.0
    some = np.flatnonzero(sizes > 0)
    # (block, cell): a cell lies in all blocks that its row numbers reach
    low, high = begin[some] // rows, (begin[some] + sizes[some] - 1) // rows
    block_cells = [some[(low <= j) & (j <= high)] for j in range(int(high.max(initial=-1)) + 1)]

    def one(b: pd.DataFrame) -> pd.DataFrame:
        dist = _to_pivots(b["v"], pivots)
        if second:
            room = ROUNDING * (dist + scale)
            least = np.maximum(np.maximum(dist - far, near - dist), 0.0) - room
            bound = np.sqrt(b["bound"].to_numpy(np.float64))[:, None]
            mask = least <= bound * (1 + ROUNDING)
            for row, cells in enumerate(b["first"]):
                mask[row, cells] = False
        else:
            mask = _first_cells(dist, sizes, need)
        mask &= sizes > 0
        work = mask @ sizes
        parts, new = [], np.ones(len(b), bool)
        for j, cells in enumerate(block_cells):
            asks = mask[:, cells]
            at = np.flatnonzero(asks.any(axis=1))
            if not len(at):
                continue
            part = b.iloc[at][["q", "v"]].assign(
                home=dist.argmin(axis=1)[at].astype("int32"), bound=b["bound"].to_numpy(np.float64)[at],
                xb=np.int32(j), cells=[cells[asks[r]].astype(np.int32) for r in at], work=np.where(new[at], work[at], 0))
            part.insert(4, "first", [np.zeros(0, np.int32) if second else np.flatnonzero(mask[r]).astype(np.int32) for r in at])
            new[at] = False
            parts.append(part)
        return pd.concat(parts, ignore_index=True) if parts else None

    def run(batches):
        for b in batches:
            for a in range(0, len(b), ROUTE_ROWS):
                out = one(b.iloc[a:a + ROUTE_ROWS].reset_index(drop=True))
                if out is not None:
                    yield out

    return run


def _block_topk(k: int, exclude_self: bool):
    """First ``k`` of the queries of a block among the rows of the cells they visit."""
    def run(qpdf: pd.DataFrame, xpdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"q": pd.Series([], dtype="int64"), "x": pd.Series([], dtype="int64"),
                             "d2": pd.Series([], dtype="float64")})
        if len(qpdf) == 0 or len(xpdf) == 0:
            return none
        xpdf = xpdf.sort_values("cell", kind="stable")
        cell = xpdf["cell"].to_numpy(np.int64)
        names, low = np.unique(cell, return_index=True)
        high = np.append(low[1:], len(cell))
        qid, xid = qpdf["q"].to_numpy(np.int64), xpdf["x"].to_numpy(np.int64)
        near = Nearest(_vectors(qpdf["v"]), qid, _vectors(xpdf["v"]), xid, k, exclude_self)
        near.bound(qpdf["bound"].to_numpy(np.float64))
        parts = [none]
        for a in range(0, len(qid), Q_CELL_ROWS):
            asked = qpdf["cells"].iloc[a:a + Q_CELL_ROWS]
            counts = asked.map(len).to_numpy()
            asks = np.zeros((len(names), len(asked)), bool)
            wanted = np.concatenate(asked.to_list())
            at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
            held = names[at] == wanted
            asks[at[held], np.repeat(np.arange(len(asked)), counts)[held]] = True
            rows, cols, d2 = near.search(a, a + len(asked), (
                (a + np.flatnonzero(asks[c]), low[c], high[c]) for c in range(len(names))))
            parts.append(pd.DataFrame({"q": qid[rows], "x": xid[cols], "d2": d2}))
        return pd.concat(parts, ignore_index=True)
    return run


def knn_pruned(queries: DataFrame, index: DataFrame, k: int, q_key: str = "query_id", x_key: str = "vec_id",
               q_vec: str = "embedding", x_vec: str = "embedding", exclude_self: bool = False,
               pivots: int | None = None, block_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(hits, work)``: the hits are those of ``vectors.knn`` (q_key, rank, x_key, d2).

    ``work`` has one row: n_queries, n_index, n_cells, distances (between queries
    and rows) and pivot_distances (of queries and rows to pivots).
    """
    spark = queries.sparkSession
    ship_package(spark)
    checkpoint_dir(spark)
    vector = queries.schema[q_vec].dataType.simpleString()
    q = queries.where(usable(q_vec)).select(F.col(q_key).cast("long").alias("q"), F.col(q_vec).alias("v"))
    x = index.where(usable(x_vec)).select(F.col(x_key).cast("long").alias("x"), F.col(x_vec).alias("v"))
    size = x.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w")).first()
    if not size["n"]:
        nothing = spark.createDataFrame([], f"{q_key} long, rank int, {x_key} long, d2 double")
        return nothing, q.agg(F.count(F.lit(1)).alias("n_queries")).select("n_queries", *(
            F.lit(0).cast("long").alias(c) for c in ("n_index", "n_cells", "distances", "pivot_distances")))
    width = max(1, size["w"])
    most = max(1, PIVOT_NUMBERS // width)
    wanted = min(most, pivots or max(1, isqrt(size["n"])))
    chosen = x.orderBy(F.xxhash64("x"), "x").limit(wanted).select("v").toPandas()["v"]
    points = np.unique(np.stack(chosen.to_numpy()).astype(np.float64), axis=0)

    def assign(batches):
        for whole in batches:
            for a in range(0, len(whole), ROUTE_ROWS):
                b = whole.iloc[a:a + ROUTE_ROWS]
                dist = _to_pivots(b["v"], points)
                cell = dist.argmin(axis=1)
                yield b.assign(cell=cell.astype("int32"), r=dist[np.arange(len(b)), cell])

    x = x.mapInPandas(assign, f"x long, v {index.schema[x_vec].dataType.simpleString()}, cell int, r double").checkpoint()
    stats = x.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("a"), F.max("r").alias("b")).toPandas()
    sizes, near, far = np.zeros(len(points), np.int64), np.zeros(len(points)), np.zeros(len(points))
    sizes[stats["cell"]], near[stats["cell"]], far[stats["cell"]] = stats["n"], stats["a"], stats["b"]
    need = k + 1 if exclude_self else k
    place = _line_up(points)
    begin, rows_of_block = _spread(sizes, place), block_rows or max(1, X_BLOCK_NUMBERS // width)
    cells = spark.createDataFrame([(c, int(n), int(b)) for c, (n, b) in enumerate(zip(sizes, begin))],
                                  "cell int, n long, begin long")
    x = x.join(F.broadcast(cells), "cell").select(
        "x", "v", "cell", F.expr(f"cast((begin + pmod(xxhash64(x), n)) div {rows_of_block} as int)").alias("xb"))
    q_rows, blocks = block_rows or max(1, Q_BLOCK_NUMBERS // width), -(-size["n"] // rows_of_block)
    par = int(spark.conf.get("spark.sql.shuffle.partitions"))
    routed_type = (f"q long, v {vector}, home int, bound double, first array<int>, xb int, cells array<int>, work long")

    def route(asking: DataFrame, second: bool) -> DataFrame:
        return asking.mapInPandas(_router(points, sizes, near, far, need, second, begin, rows_of_block), routed_type)

    # queries are numbered along the line like rows: by home cell, spread inside a cell by a hash
    order = spark.createDataFrame([(c, int(p)) for c, p in enumerate(place)], "home int, place int")

    def visit(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Top k of every (query, block of rows), and the number of distances."""
        homes = routed.where("work > 0").groupBy("home").agg(F.count(F.lit(1)).alias("nq")).join(
            F.broadcast(order), "home").toPandas().sort_values("place")
        nq = homes["nq"].to_numpy(np.int64)
        # as many tiles as tasks may run, where there are queries enough
        per_block = max(1, min(q_rows, max(Q_LEAST_ROWS, -(-int(nq.sum()) * blocks // par))))
        starts = spark.createDataFrame([(int(h), int(n), int(b)) for h, n, b in zip(homes["home"], nq, np.cumsum(nq) - nq)],
                                       "home int, nq long, start long")
        left = routed.join(F.broadcast(starts), "home").select(
            "q", "v", "bound", "cells", "xb",
            F.expr(f"cast((start + pmod(xxhash64(q), nq)) div {per_block} as int)").alias("qb")).checkpoint()
        asked = left.select(F.col("xb").alias("of_block"), F.col("qb").alias("to_block")).distinct()
        right = x.join(F.broadcast(asked), F.col("xb") == F.col("of_block")).select("x", "v", "cell", "of_block", "to_block")
        hits = left.groupBy("qb", "xb").cogroup(right.groupBy("to_block", "of_block")).applyInPandas(
            _block_topk(k, exclude_self), "q long, x long, d2 double")
        return hits, routed.agg(F.coalesce(F.sum("work"), F.lit(0)).alias("d"))

    def best(hits: DataFrame) -> DataFrame:
        w = Window.partitionBy("q").orderBy("d2", "x")
        return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    unknown = F.lit(float("inf")).alias("bound")
    one = route(q.select("q", "v", unknown, F.array().cast("array<int>").alias("first")), False).checkpoint()
    found, first_work = visit(one)
    found = best(found).checkpoint()
    bound = found.where(F.col("rank") == k).select("q", F.col("d2").alias("bound"))
    # one of a query's routed rows has its work: that row stands for the query
    two = one.where("work > 0").drop("bound").join(bound, "q", "left").select(
        "q", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"), "first")
    two = route(two, True).checkpoint()
    more, second_work = visit(two)
    hits = best(found.select("q", "x", "d2").unionByName(more)).select(
        F.col("q").alias(q_key), "rank", F.col("x").alias(x_key), "d2")
    count = q.agg(F.count(F.lit(1)).alias("n_queries"))
    work = count.select("n_queries", F.lit(size["n"]).alias("n_index"), F.lit(len(points)).alias("n_cells"),
                        (first_work.scalar() + second_work.scalar()).alias("distances"),
                        ((F.col("n_queries") + F.lit(size["n"])) * len(points)).alias("pivot_distances"))
    return hits, work
