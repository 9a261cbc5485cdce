"""Exact top-k search by inner product with vector-approximation files.

1. Vectors go to pages (``vector_pages``); beside its exact components a page stores an approximation: each
   component's cell among 16 of equal width between the least and the largest of its
   dimension in the page, four bits each.
2. Scan of the approximations alone: a query's inner product with a vector lies between the sums
   of its least and its largest products with the vector's cells. The k-th largest lower bound
   of any group of pages is a floor that the k-th best score cannot miss.
3. Vectors whose upper bound reaches the floor are read exactly, in the order of that bound, in
   batches of growing size, until the k-th best score is at or over every bound left.
4. Groups of pages return at most k rows a query; a window ranks them.

Rows: ``query_id, rank, vec_id, score``. Every row is a candidate of its own, also one that
repeats an id or a vector; a query's own row is no candidate. Ties go to the smaller id (null
last), then to the earlier row. Vectors that are null or hold a null or non-finite component take no part;
vectors of another length than the query's have no score with it; empty vectors score 0. A row
without an id is a candidate, and a query if ``queries`` holds for it. Empty tables give no rows.
Only the named columns are read.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchsmith.llm import vector_pages as VP
from matchsmith.llm.common import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELLS = 16
SCALE, K = 64, 20
# Candidates of a query, in multiples of k, that the first batch of exact reads holds.
FIRST = 2


def approximate(x: np.ndarray) -> dict:
    """Cells of a page's components, two to a byte, and the range of each dimension."""
    low, high = x.min(axis=0, initial=np.inf), x.max(axis=0, initial=-np.inf)
    width = (high - low) / CELLS
    cell = np.minimum((x - low) / np.where(width > 0, width, 1), CELLS - 1).astype(np.uint8)
    if cell.shape[1] % 2:
        cell = np.pad(cell, ((0, 0), (0, 1)))
    return {"cells": (cell[:, ::2] << 4 | cell[:, 1::2]).tobytes(), "ranges": np.concatenate([low, width]).astype("<f8").tobytes()}


def cell_bounds(page: dict) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) value that each component of a page's vectors may have."""
    n, dim = len(page["rows"]), page["dim"]
    pair = np.frombuffer(page["cells"], np.uint8).reshape(n, -1)
    cell = np.stack([pair >> 4, pair & 15], axis=2).reshape(n, -1)[:, :dim]
    low, width = np.frombuffer(page["ranges"], "<f8").reshape(2, dim)
    least = low + cell * width
    return least, least + width


def score_bounds(q: np.ndarray, least: np.ndarray, largest: np.ndarray, lower: bool = True):
    """(lower, upper) bounds of the inner products of queries and vectors."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return up @ least.T + down @ largest.T if lower else None, up @ largest.T + down @ least.T


def floors(pages: list[dict], asked: pa.Table, k: int) -> pa.Table:
    """The k-th largest lower bound of each query among the pages' vectors."""
    rows, out = [], []
    for dim in sorted({p["dim"] for p in pages} & set(asked["dim"].to_pylist())):
        mine = VP.Asked(asked, dim)
        top = np.full((mine.n, k), -np.inf)
        for page in pages:
            if page["dim"] != dim:
                continue
            least, largest = cell_bounds(page)
            if not VP.is_small(mine.x, np.maximum(np.abs(least), np.abs(largest))):
                continue  # bounds that doubles can't hold exactly give no floor
            held = np.array(page["rows"])
            for a, b in mine.tiles():
                low, _ = score_bounds(mine.x[a:b], least, largest)
                low[VP.own(mine.row[a:b], held)] = -np.inf
                both = np.concatenate([top[a:b], low], axis=1)
                top[a:b] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        rows.append(mine.row)
        out.append(top.min(axis=1))
    if not rows:
        return None
    return pa.table([pa.array(np.concatenate(rows)), pa.array(np.concatenate(out))], ["q_row", "floor"])


def nearest(pages: list[dict], asked: pa.Table, k: int) -> pa.Table:
    """At most k best vectors of the pages for each query: exact reads in the order of the upper bound."""
    parts = []
    for dim in sorted({p["dim"] for p in pages} & set(asked["dim"].to_pylist())):
        mine = VP.Asked(asked, dim)
        best = VP.Best(mine.n, k)
        floor = mine.rows["floor"].to_numpy()
        for page in pages:
            if page["dim"] != dim:
                continue
            x, held = VP.unpacked(page["exact"], len(page["rows"]), dim), np.array(page["rows"])
            keys, null = VP.page_keys(page)
            least, largest = cell_bounds(page)
            small = VP.is_small(mine.x, np.maximum(np.abs(least), np.abs(largest)))
            for a, b in mine.tiles():
                q = mine.x[a:b]
                upper = score_bounds(q, least, largest, lower=False)[1] if small else np.full((b - a, len(held)), np.inf)
                upper[VP.own(mine.row[a:b], held)] = -np.inf
                qi, ci = np.nonzero((upper >= np.maximum(floor, best.kth)[a:b, None]) & (upper > -np.inf))
                bound = upper[qi, ci]
                order = np.lexsort((-bound, qi))
                qi, ci, bound = qi[order], ci[order], bound[order]
                nth = np.arange(len(qi)) - np.searchsorted(qi, qi)
                start, size = 0, FIRST * k
                while len(qi):
                    now = nth < start + size
                    score = VP.pair_scores(q, x, qi[now], ci[now])
                    best.add(a + qi[now], score, keys[ci[now]], null[ci[now]], held[ci[now]])
                    left = ~now & (bound >= best.kth[a + qi])
                    qi, ci, bound, nth = qi[left], ci[left], bound[left], nth[left]
                    start, size = start + size, 4 * size
        # a score under the floor is in no result: the floor is reached by k others
        keep = best.score >= floor[best.q]
        q = best.q[keep]
        parts.append(pa.table([mine.rows["q_row"].take(pa.array(q)), mine.rows["q_key"].take(pa.array(q)),
                               pa.array(best.key[keep], mask=best.null[keep]), pa.array(best.row[keep]), pa.array(best.score[keep])],
                              ["q_row", "query_id", "vec_id", "row", "score"]))
    return pa.concat_tables(parts) if parts else None


def search(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: float = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows for which ``queries`` holds (see the module)."""
    scratch = Scratch(df.sparkSession, "exact-search")
    table = scratch.table(VP.pages(df, key, vector, scale, queries, None, approximate, "cells binary, ranges binary"), "pages")
    asked = scratch.table(VP.queries(table), "queries")
    grid = VP.Grid(table, asked)
    approximation = ["page", "dim", "rows", "cells", "ranges"]
    known = scratch.table(grid.compare(table, approximation, asked, lambda p, q: floors(p, q, k), "q_row long, floor double")
                          .groupBy("q_row").agg(F.max("floor").alias("floor")), "floors")
    found = grid.compare(table, [*approximation, "keys", "exact"], asked.join(known, "q_row"), lambda p, q: nearest(p, q, k),
                         "q_row long, query_id long, vec_id long, row long, score long")
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
