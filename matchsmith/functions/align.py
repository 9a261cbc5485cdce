"""Alignment measures Spark has no built-in for (Jaro, Jaro-Winkler, Monge-Elkan,
Needleman-Wunsch, Smith-Waterman), as Arrow-batched ``pandas_udf``s.

A kernel takes the distinct pairs of a whole Arrow batch at once, as matrices of code points with one
row a pair: the loops run over character places, never over pairs. Pairs go in order of length,
in blocks of bounded size. Monge-Elkan compares the distinct word pairs of a block once. Null or empty
sides give null.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as TY

# Ship these kernels to the Python workers by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the measures: Winkler prefix weight and length, boost threshold, gap cost.
WINKLER_PREFIX_WEIGHT = 0.1
WINKLER_MAX_PREFIX = 4
WINKLER_BOOST_THRESHOLD = 0.7
GAP_COST = 1.0


# Cells of a block's matrices (pairs x places).
BLOCK_CELLS = 1 << 20


def _codes(strings: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """(code points, one row a string, padded with ``fill``; lengths)."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = np.full((len(strings), int(size.max(initial=0))), fill, np.int64)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = flat
    return out, size


def _blocks(a: list[str], b: list[str]):
    """Indices of pairs, by length, in blocks whose matrices hold at most ``BLOCK_CELLS`` cells (one
    pair at least)."""
    size = np.maximum(np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))) + 1
    order = np.argsort(size, kind="stable")
    start = 0
    for at in range(1, len(order) + 1):
        if at == len(order) or (at + 1 - start) * int(size[order[at]]) > BLOCK_CELLS:
            yield order[start:at]
            start = at


def _in_blocks(kernel):
    """A kernel over lists of strings, block by block."""
    def run(a: list[str], b: list[str]) -> np.ndarray:
        out = np.zeros(len(a))
        for block in _blocks(a, b):
            out[block] = kernel([a[i] for i in block], [b[i] for i in block])
        return out
    return run


def _jaro(a: list[str], b: list[str]) -> np.ndarray:
    x, n1 = _codes(a, -1)
    y, n2 = _codes(b, -2)
    window = np.maximum(np.maximum(n1, n2) // 2 - 1, 0)
    m1, m2 = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
    places, rows = np.arange(y.shape[1])[None, :], np.arange(len(a))
    for i in range(x.shape[1]):  # the first free equal character in the window
        free = (y == x[:, i:i + 1]) & ~m2 & (np.abs(places - i) <= window[:, None])
        at = free.argmax(axis=1) if y.shape[1] else np.zeros(len(a), np.int64)
        hit = free[rows, at] if y.shape[1] else np.zeros(len(a), bool)
        m1[hit, i] = True
        m2[rows[hit], at[hit]] = True
    m = m1.sum(axis=1)
    most = int(m.max(initial=0))
    packed = [np.take_along_axis(c, np.argsort(~h, axis=1, kind="stable")[:, :most], axis=1) for c, h in ((x, m1), (y, m2))]
    apart = ((packed[0] != packed[1]) & (np.arange(most)[None, :] < m[:, None])).sum(axis=1) // 2
    safe = np.maximum(m, 1)
    return np.where(m > 0, (m / np.maximum(n1, 1) + m / np.maximum(n2, 1) + (m - apart) / safe) / 3.0, 0.0)


def _jaro_winkler(a: list[str], b: list[str]) -> np.ndarray:
    score = _jaro(a, b)
    x, _ = _codes([s[:WINKLER_MAX_PREFIX] for s in a], -1)
    y, _ = _codes([s[:WINKLER_MAX_PREFIX] for s in b], -2)
    k = min(x.shape[1], y.shape[1])
    prefix = np.cumprod(x[:, :k] == y[:, :k], axis=1).sum(axis=1)
    return np.where(score > WINKLER_BOOST_THRESHOLD, score + prefix * WINKLER_PREFIX_WEIGHT * (1.0 - score), score)


jaro, jaro_winkler = _in_blocks(_jaro), _in_blocks(_jaro_winkler)


def monge_elkan(a: list[str], b: list[str]) -> np.ndarray:
    """Mean over the words of ``a`` of the best Jaro-Winkler match among the words of ``b``."""
    out = np.zeros(len(a))
    for block in _blocks(a, b):
        ta, tb = [a[i].split() for i in block], [b[i].split() for i in block]
        na, nb = (np.fromiter(map(len, t), np.int64, len(t)) for t in (ta, tb))
        if not (na * nb).sum():
            continue
        words, of = np.unique(np.array([w for t in (*ta, *tb) for w in t], object), return_inverse=True)
        wa, wb = of[:na.sum()], of[na.sum():]
        owner = np.repeat(np.arange(len(block)), na)  # of each word of a
        times = nb[owner]
        first = np.repeat((np.cumsum(nb) - nb)[owner], times)
        right = wb[first + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)]
        pairs, back = np.unique(np.repeat(wa, times) * len(words) + right, return_inverse=True)
        score = jaro_winkler(words[pairs // len(words)].tolist(), words[pairs % len(words)].tolist())[back]
        held = times > 0
        best = np.zeros(len(wa))
        best[held] = np.maximum.reduceat(score, (np.cumsum(times) - times)[held])
        out[block] = np.where((na > 0) & (nb > 0), np.bincount(owner, weights=best, minlength=len(block)) / np.maximum(na, 1), 0.0)
    return out


def _dp(a: list[str], b: list[str], gap: float, local: bool) -> np.ndarray:
    """Alignment scores, match 1, mismatch 0, gap -gap: one row of the table a step for all pairs; the
    recurrence along the row is a running maximum."""
    x, n1 = _codes(a, -1)
    y, n2 = _codes(b, -2)
    ar = np.arange(y.shape[1] + 1, dtype=np.float64) * gap
    prev = np.zeros((len(a), y.shape[1] + 1)) if local else np.tile(-ar, (len(a), 1))
    rows, inside = np.arange(len(a)), np.arange(y.shape[1] + 1)[None, :] <= n2[:, None]
    out = np.zeros(len(a)) if local else prev[rows, n2]
    for i in range(1, x.shape[1] + 1):
        t = np.empty_like(prev)
        t[:, 0] = 0.0 if local else -i * gap
        t[:, 1:] = np.maximum(prev[:, :-1] + (y == x[:, i - 1:i]), prev[:, 1:] - gap)
        if local:
            t = np.maximum(t, 0.0)
        prev = np.maximum.accumulate(t + ar, axis=1) - ar
        if local:
            out = np.where(i <= n1, np.maximum(out, np.where(inside, prev, 0.0).max(axis=1)), out)
        else:
            out = np.where(i == n1, prev[rows, n2], out)
    return out


needleman_wunsch = _in_blocks(lambda a, b: _dp(a, b, GAP_COST, False))
smith_waterman = _in_blocks(lambda a, b: _dp(a, b, GAP_COST, True))


def _lift(kernel):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        held = (a.notna() & b.notna() & (a != "") & (b != "")).to_numpy(bool)
        out = np.full(len(a), np.nan)
        if held.any():  # each distinct pair once
            ca, ua = pd.factorize(a[held])
            cb, ub = pd.factorize(b[held])
            pairs, back = np.unique(ca.astype(np.int64) * len(ub) + cb, return_inverse=True)
            out[held] = kernel([ua[i] for i in pairs // len(ub)], [ub[i] for i in pairs % len(ub)])[back]
        return pd.Series(out)
    return F.pandas_udf(run, TY.DoubleType())


jaro_udf = _lift(jaro)
jaro_winkler_udf = _lift(jaro_winkler)
monge_elkan_udf = _lift(monge_elkan)
needleman_wunsch_udf = _lift(needleman_wunsch)
smith_waterman_udf = _lift(smith_waterman)
