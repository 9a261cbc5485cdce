import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchsmith.functions import align as AL


def nw_ref(a, b, gap=1.0):
    H = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        H[i][0] = -i * gap
    for j in range(len(b) + 1):
        H[0][j] = -j * gap
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            H[i][j] = max(H[i - 1][j - 1] + (a[i - 1] == b[j - 1]), H[i - 1][j] - gap,
                          H[i][j - 1] - gap)
    return H[-1][-1]


def sw_ref(a, b, gap=1.0):
    H = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0.0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            H[i][j] = max(0.0, H[i - 1][j - 1] + (a[i - 1] == b[j - 1]), H[i - 1][j] - gap,
                          H[i][j - 1] - gap)
            best = max(best, H[i][j])
    return best


def jaro_ref(s1: str, s2: str) -> float:
    n1, n2 = len(s1), len(s2)
    if n1 == 0 or n2 == 0:
        return 0.0
    window = max(max(n1, n2) // 2 - 1, 0)
    m1 = [False] * n1
    m2 = [False] * n2
    matches = 0
    for i, c in enumerate(s1):
        lo, hi = max(0, i - window), min(i + window + 1, n2)
        for j in range(lo, hi):
            if not m2[j] and s2[j] == c:
                m1[i] = m2[j] = True
                matches += 1
                break
    if matches == 0:
        return 0.0
    t, k = 0, 0
    for i in range(n1):
        if m1[i]:
            while not m2[k]:
                k += 1
            if s1[i] != s2[k]:
                t += 1
            k += 1
    t //= 2
    return (matches / n1 + matches / n2 + (matches - t) / matches) / 3.0


def jaro_winkler_ref(s1: str, s2: str) -> float:
    j = jaro_ref(s1, s2)
    if j <= AL.WINKLER_BOOST_THRESHOLD:
        return j
    prefix = 0
    for a, b in zip(s1[:AL.WINKLER_MAX_PREFIX], s2[:AL.WINKLER_MAX_PREFIX]):
        if a != b:
            break
        prefix += 1
    return j + prefix * AL.WINKLER_PREFIX_WEIGHT * (1.0 - j)


def monge_elkan_ref(a: str, b: str) -> float:
    """Mean over the words of ``a`` of the best Jaro-Winkler match among the words of ``b``."""
    ta, tb = a.split(), b.split()
    if not ta or not tb:
        return 0.0
    return float(np.mean([max(jaro_winkler_ref(x, y) for y in tb) for x in ta]))


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32)


PAIRS = [("martha", "marhta"), ("dwayne", "duane"), ("dixon", "dicksonx"), ("abc", "abc"),
         ("kitten", "sitting"), ("café noir", "cafe noire"), ("a", "b"), ("😀 x", "x 😀"), (" ", "  ")]
REFS = {AL.jaro: jaro_ref, AL.jaro_winkler: jaro_winkler_ref, AL.monge_elkan: monge_elkan_ref, AL.needleman_wunsch: nw_ref,
        AL.smith_waterman: sw_ref}


def test_jaro_known_values():
    assert AL.jaro(["martha", ""], ["marhta", "x"]) == pytest.approx([0.944444, 0.0], abs=1e-6)
    assert AL.jaro_winkler(["martha", "dwayne"], ["marhta", "duane"]) == pytest.approx([0.961111, 0.84], abs=1e-6)


@pytest.mark.parametrize("cells", [1, 200, 1 << 20])
def test_batches_match_pair_by_pair_versions(cells, monkeypatch):
    """All five measures on a batch of all lengths, in blocks of one pair, some pairs and all pairs."""
    monkeypatch.setattr(AL, "BLOCK_CELLS", cells)
    rng = random.Random(cells)
    words = ["".join(rng.choice("abcé😀") for _ in range(rng.randint(1, 9))) for _ in range(30)]
    text = lambda: rng.choice([" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))), "".join(rng.choice("ab ") for _ in range(rng.randint(1, 25)))])
    pairs = PAIRS + [(text(), text()) for _ in range(120)]
    a, b = map(list, zip(*pairs))
    for batch, plain in REFS.items():
        assert batch(a, b) == pytest.approx([plain(x, y) for x, y in pairs], abs=1e-12), plain.__name__


def test_udfs_null_and_empty(spark):
    df = spark.createDataFrame([("martha", "marhta"), ("", "x"), (None, "x"), ("martha", "marhta"), ("x", None)], "a string, b string")
    r = df.select(AL.jaro_udf("a", "b").alias("j"), AL.monge_elkan_udf("a", "b").alias("m"), AL.smith_waterman_udf("a", "b").alias("s")).collect()
    assert r[0].j == r[3].j == pytest.approx(0.944444, abs=1e-6)
    assert all(x is None for i in (1, 2, 4) for x in r[i])
