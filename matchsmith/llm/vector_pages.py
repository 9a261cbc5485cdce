"""Pages of integer vectors, and the grid of query groups and page groups that searches run on.

A page is one row with up to ``PAGE`` vectors of one length: their ids, components
``floor(scale * x)`` as exact integers, and whatever summary an operator adds. Pages are built
within the scan's tasks and written once. A search deals pages to ``salts`` groups and queries to
``slots`` groups, by hash of their row, and compares each pair of groups in one place, of a size that
does not grow with the table. Rows, not vectors, are dealt, so copies of a vector are no hot key.

Scores are exact: doubles while no sum can pass 2**53, Python integers beyond, cut to the range of
a long.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAGE, PAGE_VALUES = 8192, 1 << 20
# Queries and pages that one place compares.
QUERIES_PER_CELL, PAGES_PER_CELL = 4096, 8
# Queries of a tile; pairs scored at a time.
TILE, PAIRS = 256, 1 << 18
EXACT = 2.0 ** 53
LONG = 2 ** 63 - 1

BASE_SCHEMA = "page long, dim int, rows array<long>, keys array<long>, labels array<long>, wanted array<boolean>, exact binary"
QUERY_SCHEMA = "q_row long, q_key long, q_label long, dim int, exact binary"


def packed(x: np.ndarray) -> bytes:
    return x.astype("<i4" if np.abs(x).max(initial=0) < 2 ** 31 else "<f8").tobytes()


def unpacked(blob: bytes, n: int, dim: int) -> np.ndarray:
    kind = "<i4" if len(blob) == 4 * n * dim else "<f8"
    return np.frombuffer(blob, kind).astype(np.float64).reshape(n, dim)


def _valid(lists: pa.Array, scale: float):
    """(row numbers of usable vectors, their lengths, flat scaled components)."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists).cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(scale * flat)  # null: NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    stop = np.cumsum(size)
    ok = (bad[stop] == bad[stop - size]) & pc.is_valid(lists).to_numpy(zero_copy_only=False).astype(bool)
    return np.flatnonzero(ok), size[ok], flat[np.repeat(ok, size)]


def pages(df: DataFrame, key: str, vector: str, scale: float, wanted: Column, label: Column | None,
          summary: Callable[[np.ndarray], dict], summary_schema: str) -> DataFrame:
    """Pages of the usable vectors of ``df``; ``wanted`` marks the query rows. A vector is usable
    if it is not null and holds no null, and no component that is (or scales to) no finite number.
    With a ``label``, rows of a null label are left out."""
    schema = f"{BASE_SCHEMA}, {summary_schema}"
    rows = df.select(F.col(key).cast("long").alias("key"), (F.lit(0) if label is None else label).cast("long").alias("label"),
                     F.coalesce(wanted, F.lit(False)).alias("wanted"), F.col(vector).alias("vector")).filter("label is not null")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    names = pa.schema([(n, t) for n, t in (("page", pa.int64()), ("dim", pa.int32()), ("rows", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())),
                                           ("labels", pa.list_(pa.int64())), ("wanted", pa.list_(pa.bool_())), ("exact", pa.binary()))])

    def page(held: list, dim: int) -> pa.RecordBatch:
        x = np.concatenate([h[0] for h in held])
        meta = pa.Table.from_batches([h[1] for h in held]).combine_chunks()
        extra = summary(x)
        one = [pa.array([meta["row"][0].as_py()]), pa.array([dim], pa.int32())]
        one += [pa.array([meta[c].to_pylist()], names.field(f).type) for c, f in
                (("row", "rows"), ("key", "keys"), ("label", "labels"), ("wanted", "wanted"))]
        one += [pa.array([packed(x)], pa.binary()), *[pa.array([v], pa.binary()) for v in extra.values()]]
        return pa.RecordBatch.from_arrays(one, [*names.names, *extra])

    def run(batches):
        held: dict[int, list] = {}
        size: dict[int, int] = {}
        for batch in batches:
            ok, lens, flat = _valid(batch.column("vector"), scale)
            meta = batch.select(["row", "key", "label", "wanted"])
            first = np.cumsum(lens) - lens
            for dim in np.unique(lens).tolist():
                mine = np.flatnonzero(lens == dim)
                most = max(1, min(PAGE, PAGE_VALUES // max(dim, 1)))
                at = 0
                while at < len(mine):
                    take = mine[at:at + most - size.get(dim, 0)]
                    at += len(take)
                    x = flat[first[take][:, None] + np.arange(dim)].reshape(len(take), dim)
                    held.setdefault(dim, []).append((x, meta.take(pa.array(ok[take]))))
                    size[dim] = size.get(dim, 0) + len(take)
                    if size[dim] == most:
                        yield page(held.pop(dim), dim)
                        del size[dim]
            if sum(d * n for d, n in size.items()) > 2 * PAGE_VALUES or len(size) > PAGE:  # many lengths: smaller pages
                for dim in list(held):
                    yield page(held.pop(dim), dim)
                size.clear()
        for dim, parts in held.items():
            yield page(parts, dim)

    return rows.mapInArrow(run, schema)


def queries(table: DataFrame) -> DataFrame:
    """The rows of the pages that are queries."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                mine = np.flatnonzero(np.array(r["wanted"], bool))
                if not len(mine):
                    continue
                x = unpacked(r["exact"], len(r["rows"]), r["dim"])
                pick = lambda c: [r[c][i] for i in mine]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pick("rows"), pa.int64()), pa.array(pick("keys"), pa.int64()), pa.array(pick("labels"), pa.int64()),
                     pa.array([r["dim"]] * len(mine), pa.int32()), pa.array([packed(x[i]) for i in mine], pa.binary())],
                    ["q_row", "q_key", "q_label", "dim", "exact"])
    return table.select("rows", "keys", "labels", "wanted", "dim", "exact").mapInArrow(run, QUERY_SCHEMA)


class Grid:
    """Deals pages and queries to the places that compare them."""

    def __init__(self, table: DataFrame, asked: DataFrame):
        n_pages, n_queries = table.count(), asked.count()
        places = 2 * table.sparkSession.sparkContext.defaultParallelism
        self.slots = max(1, math.ceil(n_queries / QUERIES_PER_CELL))
        self.salts = max(1, min(n_pages, max(math.ceil(n_pages / PAGES_PER_CELL), places // self.slots)))

    def compare(self, table: DataFrame, columns: list[str], asked: DataFrame, place: Callable, schema: str) -> DataFrame:
        """``place(pages, queries) -> RecordBatch`` for each pair of groups, as Arrow tables."""
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = table.select(*columns, F.pmod(F.xxhash64("page"), F.lit(self.salts)).cast("int").alias("salt"), every(self.slots).alias("slot"))
        right = asked.select("*", F.pmod(F.xxhash64("q_row"), F.lit(self.slots)).cast("int").alias("slot"), every(self.salts).alias("salt"))

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            out = place(a.to_pylist(), b) if a.num_rows and b.num_rows else None
            return out if out is not None else empty

        empty = _empty(schema)
        return left.groupBy("slot", "salt").cogroup(right.groupBy("slot", "salt")).applyInArrow(run, schema)


def _empty(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in schema.split(", "))]).empty_table()


class Asked:
    """Queries of one length in a place."""

    def __init__(self, rows: pa.Table, dim: int):
        self.rows = rows.filter(pc.equal(rows["dim"], dim)).combine_chunks()
        self.n, self.dim = self.rows.num_rows, dim
        blobs = self.rows["exact"].to_pylist()
        self.x = np.concatenate([unpacked(b, 1, dim) for b in blobs]) if blobs else np.empty((0, dim))
        self.row = self.rows["q_row"].to_numpy()

    def tiles(self):
        for at in range(0, self.n, TILE):
            yield at, min(at + TILE, self.n)


def own(asked_rows: np.ndarray, page_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, column) where a query meets its own row; page rows rise."""
    at = np.searchsorted(page_rows, asked_rows)
    hit = (at < len(page_rows)) & (page_rows[np.minimum(at, len(page_rows) - 1)] == asked_rows)
    return np.flatnonzero(hit), at[hit]


def is_small(q: np.ndarray, x: np.ndarray) -> bool:
    """No inner product, nor a bound of one, can pass the exact range of doubles."""
    return 4 * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(q.shape[1], 1) < EXACT


def pair_scores(q: np.ndarray, x: np.ndarray, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
    """Exact inner products of the pairs, as longs."""
    if not is_small(q, x):
        big_q, big_x = {}, {}
        out = np.empty(len(qi), np.int64)
        for k, (i, j) in enumerate(zip(qi.tolist(), ci.tolist())):
            a = big_q.get(i) or big_q.setdefault(i, [int(v) for v in q[i]])
            b = big_x.get(j) or big_x.setdefault(j, [int(v) for v in x[j]])
            out[k] = max(-LONG, min(LONG, sum(map(int.__mul__, a, b))))
        return out
    return pair_products(q, x, qi, ci).astype(np.int64)


def pair_products(q: np.ndarray, x: np.ndarray, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
    """Inner products of the pairs: by one matrix product if they are many, else pair by pair."""
    if 10 * len(qi) > len(q) * len(x):
        return (q @ x.T)[qi, ci]
    out = np.empty(len(qi), q.dtype)
    for at in range(0, len(qi), PAIRS):
        out[at:at + PAIRS] = np.einsum("ij,ij->i", q[qi[at:at + PAIRS]], x[ci[at:at + PAIRS]])
    return out


class Best:
    """The ``k`` best rows of each of ``n`` queries: highest score, then least key (null last), then row."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.q = np.empty(0, np.int64)
        self.score, self.key, self.null, self.row = (np.empty(0, t) for t in (np.int64, np.int64, bool, np.int64))
        self.kth = np.full(n, -np.inf)

    def add(self, q, score, key, null, row) -> None:
        if not len(q):
            return
        cols = [np.concatenate(c) for c in ((self.q, q), (self.score, score), (self.key, key), (self.null, null), (self.row, row))]
        order = np.lexsort((cols[4], cols[2], cols[3], -cols[1], cols[0]))
        q = cols[0][order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        order = order[nth < self.k]
        self.q, self.score, self.key, self.null, self.row = (c[order] for c in cols)
        last = order[nth[nth < self.k] == self.k - 1]
        self.kth[cols[0][last]] = cols[1][last]


def page_keys(page: dict) -> tuple[np.ndarray, np.ndarray]:
    """(keys, null or not) of a page's rows."""
    null = np.array([k is None for k in page["keys"]], bool)
    return np.array([0 if k is None else k for k in page["keys"]], np.int64), null
