"""Exact search, hard negatives and fill-in-middle against brute force."""
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchsmith.llm import exact_search, fill_middle, hard_negatives, vector_pages

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def table(spark, rows, parts=3):
    schema = "vec_id long, embedding array<double>, label int, score int, row string, page int, q_row long"
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], schema).repartition(parts)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def ints(v, scale):
    return [math.floor(scale * x) for x in v]


def dot(a, b):
    return max(-vector_pages.LONG, min(vector_pages.LONG, sum(x * y for x, y in zip(a, b))))


def low_key(i):
    return (i is None, i or 0)


def brute_search(rows, k, scale, asked):
    rows = [(i, ints(v, scale)) for i, v, *_ in rows if usable(v)]
    out = []
    for n, (i, v) in enumerate(rows):
        if i is None or not asked(i):
            continue
        found = sorted(((-dot(v, w), low_key(j), j) for m, (j, w) in enumerate(rows) if m != n and len(w) == len(v)), key=lambda t: t[:2])
        out += [(i, r + 1, j, -s) for r, (s, _, j) in enumerate(found[:k])]
    return sorted(out, key=repr)


def brute_mine(rows, asked, scale=256, positives=5, negatives=10):
    rows = [(i, ints(v, scale), label) for i, v, label in rows if usable(v) and label is not None]
    out = []
    for n, (i, v, label) in enumerate(rows):
        if i is None or not asked(i):
            continue
        scored = sorted(((-dot(v, w), low_key(j), j, other == label) for m, (j, w, other) in enumerate(rows) if m != n and len(w) == len(v)),
                        key=lambda t: t[:2])
        for p, _, j, same in [s for s in scored if s[3]][:positives]:
            inside = [(s, m) for s, _, m, same in scored if not same and -30 * p <= -100 * s <= -90 * p]
            out += [(i, j, r + 1, m, -p, -s) for r, (s, m) in enumerate(inside[:negatives])]
    return sorted(out, key=repr)


def clustered(seed, n, dim, copies=40):
    """Vectors around a few centres, with one vector that many rows repeat, ties, and awkward rows."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = []
    for i in range(n):
        v = centres[i % 5] + rng.normal(size=dim) * rng.choice([0.01, 0.3, 1.0])
        rows.append((i, (v / np.linalg.norm(v)).tolist(), int(rng.integers(0, 3))))
    hot = rows[0][1]
    rows += [(n + i, hot, i % 2) for i in range(copies)]
    rows += [(n + copies, None, 1), (n + copies + 1, [float("nan")] * dim, 1), (n + copies + 2, [None] + [0.1] * (dim - 1), 1),
             (n + copies + 3, [float("inf")] * dim, 0), (20, rows[20][1], 1), (None, rows[40][1], 1), (40, [], 0), (60, [], 0), (80, [0.5], 2),
             (100, [0.5], 2), (120, [-0.25], 1), (140, [1e300] * 3, 0), (160, [1e300, -1e300, 2e9], 0), (180, [2.0 ** 40, 3.0, 1.0], 1),
             (200, [0.1] * dim, None)]
    return rows


@pytest.mark.parametrize("dim,parts", [(8, 1), (33, 4)])
def test_search_equals_brute_force(spark, dim, parts, monkeypatch):
    monkeypatch.setattr(vector_pages, "PAGE", 64)  # many pages and several tiles
    monkeypatch.setattr(vector_pages, "TILE", 7)
    rows = clustered(dim, 260, dim)
    got = exact_search.search(table(spark, rows, parts), F.col("vec_id") % 20 == 0, k=6)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_search(rows, 6, 64, lambda i: i % 20 == 0)


def test_search_over_several_query_groups(spark, monkeypatch):
    monkeypatch.setattr(vector_pages, "QUERIES_PER_CELL", 5)
    rows = clustered(3, 150, 6)
    got = exact_search.search(table(spark, rows), F.col("vec_id") % 5 == 0, k=300)  # more than there are
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_search(rows, 300, 64, lambda i: i % 5 == 0)


def test_cell_bounds_hold_every_component_and_score():
    rng = np.random.default_rng(1)
    for dim in (1, 2, 7):
        x = np.floor(rng.normal(size=(50, dim)) * 100)
        x[:, 0] = 5  # a constant dimension
        page = {"rows": list(range(50)), "dim": dim} | exact_search.approximate(x)
        least, largest = exact_search.cell_bounds(page)
        assert (least <= x).all() and (x <= largest).all()
        q = np.floor(rng.normal(size=(9, dim)) * 100)
        low, high = exact_search.score_bounds(q, least, largest)
        assert (low <= q @ x.T).all() and (q @ x.T <= high).all()


@pytest.mark.parametrize("dim", [3, 40])
def test_mining_equals_brute_force(spark, dim, monkeypatch):
    monkeypatch.setattr(vector_pages, "PAGE", 50)
    monkeypatch.setattr(vector_pages, "TILE", 4)
    rows = clustered(dim + 1, 240, dim)
    got = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 20 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_mine(rows, lambda i: i % 20 == 0)
    assert len(want) > 100
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_segment_bounds_hold_every_score():
    rng = np.random.default_rng(2)
    for dim in (0, 1, 5, 64):
        x, q = (np.floor(rng.normal(size=(n, dim)) * 300 + 40) for n in (30, 7))
        page = {"rows": list(range(30)), "dim": dim, "exact": vector_pages.packed(x)} | hard_negatives.summarise(x)
        side, held = hard_negatives.Side(q, hard_negatives.summaries(q)), hard_negatives.Side.of_page(page)
        qi, ci = np.nonzero(np.ones((7, 30), bool))
        assert len(held.levels) == (len(hard_negatives.segments(dim)))
        for level in range(len(held.levels)):
            low, high = hard_negatives.level_bounds(side, held, level, qi, ci)
            score = (q @ x.T)[qi, ci]
            assert (low <= score).all() and (score <= high).all()


def test_empty_vector_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    nulls = spark.createDataFrame([(20, None, None), (None, None, 1)], "vec_id long, embedding array<float>, label int")
    for df in (none, nulls):
        assert exact_search.search(df, F.col("vec_id") % 20 == 0).collect() == []
        assert hard_negatives.mine(df, F.col("vec_id") % 20 == 0).collect() == []


def plain_fim(key, text, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_rows(df):
    out = fill_middle.transform(df)
    out = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    return sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.collect()), key=repr)


def test_fill_middle_equals_the_rule(spark, awkward):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    rng = random.Random(5)
    shared = " ".join(f"w{rng.randrange(100)}" for _ in range(400))
    for i in range(100, 400):
        word = lambda: "".join(rng.choice("ab é😀\t\n\r\x0b \x1c <S>PM") for _ in range(rng.randint(0, 30)))
        docs.append((i, rng.choice([word(), shared[rng.randrange(900):], word() + shared + word(), " " * rng.randint(1, 500), "x" * 3000, "ab " * 900])))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit(1), "output": F.lit("o"), "form": F.lit("f"), "key": F.lit(2)})
    want = sorted(((i, *plain_fim(i, t), t or "") for i, t in docs), key=repr)
    assert fim_rows(df.repartition(3)) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_fill_middle_of_an_empty_table(spark, no_documents):
    assert fim_rows(no_documents) == []


def test_shared_passages_are_summarised_once():
    rng = random.Random(1)
    passage = " ".join(str(rng.random()) for _ in range(2000))
    known = fill_middle.Summaries()
    import pyarrow as pa
    calls = []
    plain, fill_middle.summary = fill_middle.summary, lambda c: calls.append(c) or plain(c)
    try:
        fill_middle.cuts(pa.array([passage]), np.zeros((1, 2), np.int64), known)
        first = len(calls)
        fill_middle.cuts(pa.array(["another lead " + passage, "x" + passage]), np.zeros((2, 2), np.int64), known)
    finally:
        fill_middle.summary = plain
    assert first > 50 and len(calls) - first < 10  # only the chunks around the starts are new


def test_old_summaries_are_forgotten():
    known = fill_middle.Summaries(limit=5000)
    for i in range(500):
        assert known.of(b"chunk %d " % i) == fill_middle.summary(b"chunk %d " % i)
    assert len(known.new) + len(known.old) < 60
