"""Distinct-chunk tables: segment each distinct chunk of text once, join ids back by position.

A text is cut at places no vocabulary piece can cross. Each slice of rows is dictionary-encoded
(Arrow), its distinct chunks are looked up in a table that the worker process keeps, only the
unknown ones are segmented by the tokenizer library, and the ids go back to every position of
the chunk by a gather. The table holds a bounded number of chunks; when it is full the half that
was used least goes, which costs time but never changes ids.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from matchsmith.llm.common import texts_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Chunks a worker's table holds (about 45 bytes each).
TABLE_CHUNKS = 1_250_000

# Keys of the two 64-bit halves of a chunk's 128-bit name in the table.
_KEYS = ("chunk-table-key0", "chunk-table-key1")


def gather(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenate ``values[s:s+n]`` for each (s, n)."""
    total = int(lens.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lens)
    step = np.repeat(starts - (ends - lens), lens)
    return values[step + np.arange(total, dtype=np.int64)]


def flatten(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all values in order, length of each list)."""
    lens = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(lens.sum())), lens


class ChunkTable:
    """Chunk text to ids, names hashed to 128 bits, ids in one growing buffer.

    ``segment`` gives (flat ids, number of ids by chunk) of a list of chunks.
    """

    def __init__(self, segment: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = TABLE_CHUNKS):
        self.segment, self.limit = segment, limit
        self.clear()

    def clear(self) -> None:
        self.h0 = np.empty(0, np.uint64)
        self.h1 = np.empty(0, np.uint64)
        self.start = np.empty(0, np.int64)
        self.len = np.empty(0, np.int32)
        self.used = np.empty(0, np.uint32)
        self.ids = np.empty(0, np.int32)

    def keep_most_used(self, n: int) -> None:
        """Forget all chunks but the ``n`` used most; earlier use counts half from now on."""
        if n >= len(self.h0):
            return
        keep = np.sort(np.argpartition(self.used, -n)[-n:]) if n else np.empty(0, np.int64)
        self.h0, self.h1, self.len, self.used = self.h0[keep], self.h1[keep], self.len[keep], self.used[keep] >> 1
        self.ids = gather(self.ids, self.start[keep], self.len.astype(np.int64))
        self.start = np.cumsum(self.len, dtype=np.int64) - self.len

    def ids_of(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, len): the ids of chunk i are ``ids[start[i]:start[i]+len[i]]``."""
        names = chunks.to_numpy(zero_copy_only=False)
        if not len(names):
            return self.ids, np.empty(0, np.int64), np.empty(0, np.int32)
        a = pd.util.hash_array(names, hash_key=_KEYS[0], categorize=False)
        order = np.argsort(a)  # sorted needles keep the search in cache
        a = a[order]
        if len(a) > 1 and (a[1:] == a[:-1]).any():  # two names share a half: leave the table out
            flat, lens = self.segment(list(names))
            return flat, np.cumsum(lens) - lens, lens.astype(np.int32)
        b = pd.util.hash_array(names, hash_key=_KEYS[1], categorize=False)[order]
        at, known = self._find(a, b)
        if not known.all() and len(self.h0) + int((~known).sum()) > self.limit:
            self.keep_most_used(max(0, self.limit // 2 - len(a)))
            at, known = self._find(a, b)
        self.used[at[known]] += 1
        start, lens = np.empty(len(a), np.int64), np.empty(len(a), np.int32)
        start[order[known]], lens[order[known]] = self.start[at[known]], self.len[at[known]]
        if not known.all():
            new = order[~known]
            start[new], lens[new] = self._add(a[~known], b[~known], at[~known], names[new].tolist())
        return self.ids, start, lens

    def _find(self, a, b):
        at = np.searchsorted(self.h0, a)
        if not len(self.h0):
            return at, np.zeros(len(a), bool)
        here = np.minimum(at, len(self.h0) - 1)
        return at, (self.h0[here] == a) & (self.h1[here] == b)

    def _add(self, a, b, at, chunks):
        flat, lens = self.segment(chunks)
        starts = len(self.ids) + np.cumsum(lens) - lens
        lens = lens.astype(np.int32)
        self.h0, self.h1 = np.insert(self.h0, at, a), np.insert(self.h1, at, b)
        self.start, self.len = np.insert(self.start, at, starts), np.insert(self.len, at, lens)
        self.used = np.insert(self.used, at, 1)
        self.ids = np.concatenate([self.ids, flat])
        return starts, lens


class ChunkEncoder:
    """Whole texts to ids through a chunk table.

    ``cut`` puts a NUL before each place where a text may be cut (a vectorised replacement);
    rows that ``unsafe`` matches, and rows that hold a NUL, are cut by ``careful`` instead.
    """

    def __init__(self, table: ChunkTable, cut: Callable[[pa.Array], pa.Array], unsafe: str | None,
                 careful: Callable[[str], list[str]]):
        self.table, self.cut, self.unsafe, self.careful = table, cut, unsafe, careful

    def chunks(self, col: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(flat chunks, start, count by row)."""
        odd = pc.match_substring(col, "\x00")
        if self.unsafe:
            odd = pc.or_(odd, pc.match_substring_regex(col, self.unsafe))
        odd = odd.to_numpy(zero_copy_only=False).astype(bool)
        lists = pc.split_pattern(self.cut(pc.if_else(pa.array(odd), "", col)), "\x00")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values
        start, count = offsets[:-1].copy(), np.diff(offsets)
        if odd.any():
            rows = np.flatnonzero(odd)
            extra = [self.careful(t) for t in col.take(pa.array(rows)).to_pylist()]
            sizes = np.fromiter(map(len, extra), np.int64, len(extra))
            start[rows] = len(flat) + np.cumsum(sizes) - sizes
            count[rows] = sizes
            flat = pa.concat_arrays([flat, pa.array([c for e in extra for c in e], pa.string())])
        return flat, start, count

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids in row order, number of ids by row)."""
        col = texts_of(col)
        flat, start, count = self.chunks(col)
        dic = flat.dictionary_encode()
        ids, at, n = self.table.ids_of(dic.dictionary)
        index = dic.indices.to_numpy()
        if len(index) and not (start[1:] == (start + count)[:-1]).all():
            index = gather(index, start, count)
        lens = n[index] if len(n) else np.empty(0, np.int32)
        ends = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
        stop = np.cumsum(count)
        by_row = ends[stop] - ends[stop - count]
        if not len(index):
            return np.empty(0, np.int32), by_row
        return gather(ids, at[index], lens.astype(np.int64)), by_row
