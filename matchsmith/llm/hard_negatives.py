"""Hard-negative mining with segment summaries.

1. Vectors go to pages (``vector_pages``). For each level of ``LEVELS`` segments a page stores the mean
   and the deviation of every segment of its vectors. Over a segment of L components the inner
   product of two vectors is L times the product of their means, give or take at most L times
   the product of their deviations; summed over segments this bounds the score.
2. Positives: the best rows of the anchor's label. In each page the k-th largest lower bound and the
   k-th best score so far are a floor; rows whose upper bound is under it are left out, level by
   level, and the rest are scored exactly.
3. Negatives: each positive gives a window of scores. Rows of other labels whose bounds miss all
   windows of the anchor, or only reach under the k-th best score of every window they meet, are left out level by
   level; the rest are scored exactly and kept by window.
4. Groups of pages return at most k rows an anchor or window; windows rank them.

Rows: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``. Every row is a
candidate of its own, also one that repeats an id or a vector; an anchor's own row is no positive.
Ties go to the smaller id (null last), then to the earlier row. Rows with a null label, or with a
vector that is null or holds a null or non-finite component, take no part; vectors of another
length than the anchor's have no score with it. An anchor without positives, and a positive
without rows in its window, give no rows. Empty tables give no rows. Only the named columns are read.
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

LEVELS = (4, 16)
SCALE, POSITIVES, NEGATIVES = 256, 5, 10
# A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90


def segments(dim: int) -> list[np.ndarray]:
    """First components of the segments of each level, coarse to fine."""
    return [np.unique(np.arange(n) * dim // n) for n in sorted({min(s, dim) for s in LEVELS}) if n]


def summaries(x: np.ndarray) -> list[np.ndarray]:
    """By level: segment means and deviations side by side, times the root of the segment's length."""
    out = []
    for start in segments(x.shape[1]):
        size = np.diff(np.append(start, x.shape[1]))
        mean = np.add.reduceat(x, start, axis=1) / size
        spread = np.add.reduceat((x - np.repeat(mean, size, axis=1)) ** 2, start, axis=1)
        out.append(np.concatenate([mean * np.sqrt(size), np.sqrt(spread)], axis=1).astype("<f4"))
    return out


def summarise(x: np.ndarray) -> dict:
    with np.errstate(over="ignore", invalid="ignore"):  # sums of very large vectors are not used
        found = summaries(x)
    return {"segments": np.concatenate([*found, np.empty((len(x), 0), "<f4")], axis=1).tobytes()}


class Side:
    """Exact vectors, summaries by level, and norms, of anchors or of a page."""

    def __init__(self, x: np.ndarray, levels: list[np.ndarray]):
        self.x, self.levels = x, [s.astype(np.float64) for s in levels]
        self.norm = np.sqrt((x * x).sum(axis=1))

    @classmethod
    def of_page(cls, page: dict):
        n, dim = len(page["rows"]), page["dim"]
        widths = [2 * len(s) for s in segments(dim)]
        held = np.frombuffer(page["segments"], "<f4").reshape(n, sum(widths))
        return cls(VP.unpacked(page["exact"], n, dim), np.split(held, np.cumsum(widths)[:-1], axis=1) if widths else [])

    def part(self, a: int, b: int):
        out = Side.__new__(Side)
        out.x, out.levels, out.norm = self.x[a:b], [s[a:b] for s in self.levels], self.norm[a:b]
        return out


def level_bounds(q: Side, x: Side, level: int, qi: np.ndarray, ci: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the pairs' scores by one level's summaries."""
    a, b = q.levels[level], x.levels[level]
    half = a.shape[1] // 2
    mean = VP.pair_products(a[:, :half], b[:, :half], qi, ci)
    slack = VP.pair_products(a[:, half:], b[:, half:], qi, ci)
    slack = slack + 1e-5 * q.norm[qi] * x.norm[ci] + 1e-3  # summaries are rounded to single precision
    return mean - slack, mean + slack


def _by_dim(pages: list[dict], asked: pa.Table):
    """(anchors, pages) of each length of vectors."""
    for dim in sorted({p["dim"] for p in pages} & set(asked["dim"].to_pylist())):
        mine = VP.Asked(asked, dim)
        yield mine, Side(mine.x, summaries(mine.x)), [p for p in pages if p["dim"] == dim]


def kth_largest(qi: np.ndarray, value: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th largest value of each query; minus infinity where there are fewer."""
    order = np.lexsort((-value, qi))
    q = qi[order]
    last = np.arange(len(q)) - np.searchsorted(q, q) == k - 1
    out = np.full(n, -np.inf)
    out[q[last]] = value[order[last]]
    return out


def positives_in(pages: list[dict], asked: pa.Table, k: int) -> pa.Table:
    """At most k best rows of each anchor's label."""
    parts = []
    for mine, side, own_pages in _by_dim(pages, asked):
        best = VP.Best(mine.n, k)
        label = mine.rows["q_label"].to_numpy()
        for page in own_pages:
            x, held = Side.of_page(page), np.array(page["rows"])
            keys, null = VP.page_keys(page)
            small = VP.is_small(mine.x, x.x)
            for a, b in mine.tiles():
                tile = side.part(a, b)
                same = label[a:b, None] == np.array(page["labels"])[None, :]
                same[VP.own(mine.row[a:b], held)] = False
                qi, ci = np.nonzero(same)
                for level in range(len(x.levels) if small else 0):
                    low, high = level_bounds(tile, x, level, qi, ci)
                    floor = np.maximum(best.kth[a:b], kth_largest(qi, low, b - a, k))
                    left = high >= floor[qi]
                    qi, ci = qi[left], ci[left]
                best.add(a + qi, VP.pair_scores(tile.x, x.x, qi, ci), keys[ci], null[ci], held[ci])
        parts.append(_found(mine, best, best.q))
    return pa.concat_tables(parts) if parts else None


def negatives_in(pages: list[dict], asked: pa.Table, k: int) -> pa.Table:
    """At most k best rows of other labels in each window of each anchor."""
    parts = []
    for mine, side, own_pages in _by_dim(pages, asked):
        label = mine.rows["q_label"].to_numpy()
        least, most = (_matrix(mine.rows[c].to_pylist(), fill) for c, fill in (("least", VP.LONG), ("most", -VP.LONG)))
        width = least.shape[1]
        best = VP.Best(mine.n * width, k)
        for page in own_pages:
            x, held = Side.of_page(page), np.array(page["rows"])
            keys, null = VP.page_keys(page)
            small = VP.is_small(mine.x, x.x)
            for a, b in mine.tiles():
                tile, lo, hi = side.part(a, b), least[a:b], most[a:b]
                qi, ci = np.nonzero(label[a:b, None] != np.array(page["labels"])[None, :])
                for level in range(len(x.levels) if small else 0):
                    low, high = level_bounds(tile, x, level, qi, ci)
                    floor = np.maximum(lo, best.kth.reshape(-1, width)[a:b])
                    meets = np.zeros(len(qi), bool)
                    for w in range(width):
                        meets |= (high >= floor[qi, w]) & (low <= hi[qi, w])
                    qi, ci = qi[meets], ci[meets]
                score = VP.pair_scores(tile.x, x.x, qi, ci)
                for w in range(width):
                    inside = (score >= lo[qi, w]) & (score <= hi[qi, w]) & (score >= best.kth[(a + qi) * width + w])
                    best.add((a + qi[inside]) * width + w, score[inside], keys[ci[inside]], null[ci[inside]], held[ci[inside]])
        parts.append(_found(mine, best, best.q // width).append_column("nth", pa.array(best.q % width)))
    return pa.concat_tables(parts) if parts else None


def _matrix(lists: list[list[int]], fill: int) -> np.ndarray:
    out = np.full((len(lists), max(map(len, lists))), fill, np.int64)
    for row, values in zip(out, lists):
        row[:len(values)] = values
    return out


def _found(mine: VP.Asked, best: VP.Best, q: np.ndarray) -> pa.Table:
    return pa.table([mine.rows["q_row"].take(pa.array(q)), pa.array(best.key, mask=best.null), pa.array(best.row), pa.array(best.score)],
                    ["q_row", "key", "row", "score"])


def mine(df: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES,
         negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = SCALE) -> DataFrame:
    """Hard negatives of the rows for which ``anchors`` holds (see the module)."""
    scratch = Scratch(df.sparkSession, "hard-negatives")
    table = scratch.table(VP.pages(df, key, vector, scale, anchors, F.col(label), summarise, "segments binary"), "pages")
    asked = scratch.table(VP.queries(table), "anchors")
    grid = VP.Grid(table, asked)
    columns = ["page", "dim", "rows", "keys", "labels", "segments", "exact"]
    found = grid.compare(table, columns, asked, lambda p, q: positives_in(p, q, positives), "q_row long, key long, row long, score long")
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), F.asc_nulls_last("key"), "row")
    chosen = scratch.table(
        found.withColumn("nth", F.row_number().over(order).cast("long") - 1).filter(F.col("nth") < positives)
        .select("q_row", "nth", F.col("key").alias("positive_id"), F.col("score").alias("positive_score"),
                F.ceil(F.lit(low) * F.col("score").cast("decimal(38,0)") / F.lit(100)).cast("long").alias("least"),
                F.floor(F.lit(high) * F.col("score").cast("decimal(38,0)") / F.lit(100)).cast("long").alias("most")), "positives")
    # the windows of an anchor, in the order of its positives
    windows = (chosen.groupBy("q_row").agg(F.sort_array(F.collect_list(F.struct("nth", "least", "most"))).alias("w"))
               .select("q_row", F.col("w.least").alias("least"), F.col("w.most").alias("most")))
    hard = grid.compare(table, columns, asked.join(windows, "q_row"), lambda p, q: negatives_in(p, q, negatives),
                        "q_row long, key long, row long, score long, nth long")
    order = Window.partitionBy("q_row", "nth").orderBy(F.desc("score"), F.asc_nulls_last("key"), "row")
    ranked = hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return (ranked.join(chosen, ["q_row", "nth"]).join(asked.select("q_row", F.col("q_key").alias("anchor_id")), "q_row")
            .select("anchor_id", "positive_id", "rank", F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
