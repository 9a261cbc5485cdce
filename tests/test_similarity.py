import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from matchsmith.functions import similarity as S
from matchsmith.plans import training_sets as TS


def bag_jaccard(a, b):
    ca, cb = Counter(a.split()), Counter(b.split())
    if not ca and not cb:
        return 1.0
    inter = sum((ca & cb).values())
    return inter / (sum(ca.values()) + sum(cb.values()) - inter)


TEXTS = [("a b b c", "b b d"), ("", ""), ("x", ""), ("same words", "same words"),
         ("p q r", "s t")]


def test_multiset_jaccard_column_and_explode_forms(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(TEXTS)],
                               "k int, a string, b string")
    col = {r.k: r.s for r in df.select("k", S.multiset_jaccard(
        F.split(F.col("a"), " ").alias("x"), F.split(F.col("b"), " ")).alias("s")).collect()}
    ex = {r.k: r.sim for r in S.multiset_jaccard_pairs(df, "k", "a", "b").collect()}
    for i, (a, b) in enumerate(TEXTS):
        assert ex[i] == pytest.approx(bag_jaccard(a, b))
        assert 0.0 <= ex[i] <= 1.0
    assert ex[3] == 1.0 and ex[1] == 1.0
    # the in-row form splits '' into [''] - compare only rows without empty sides
    for i in (0, 3, 4):
        assert col[i] == pytest.approx(bag_jaccard(*TEXTS[i]))


@pytest.mark.parametrize("hot", [1, 2, 256])
def test_cluster_similarity_inverted_index_matches_all_pairs(spark, hot):
    rnd = random.Random(3)
    vocab = ["w%d" % i for i in range(12)]
    rows = []
    for c in range(9):
        for _ in range(rnd.randint(1, 4)):
            rows.append((f"c{c}", " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 5)))))
    rows.append(("c9", "lonely"))
    clean = spark.createDataFrame(rows, "cluster_id string, title string")
    clusters = clean.select("cluster_id").distinct()
    sims = TS.cluster_similarity(TS.cluster_bags(clean, clusters), hot)
    got = {(r.cluster_id, r.other): r.sim for r in sims.collect()}
    bags = {}
    for c, t in rows:
        bags.setdefault(c, Counter()).update(t.split())
    for a in bags:
        for b in bags:
            if a == b:
                continue
            inter = sum((bags[a] & bags[b]).values())
            exp = inter / (sum(bags[a].values()) + sum(bags[b].values()) - inter)
            assert got.get((a, b), 0.0) == pytest.approx(exp)
    # symmetric
    for (a, b), v in got.items():
        assert got[(b, a)] == pytest.approx(v)
    # top-k with zero fill-up: same as ranking all other clusters by (sim desc, id)
    for k in (2, 5, 9):
        top = TS.top_similar(sims, clusters, k).collect()
        mine = {}
        for r in top:
            mine.setdefault(r.cluster_id, []).append((r.rank, r.other))
        for a in bags:
            full = sorted((b for b in bags if b != a), key=lambda b: (-got.get((a, b), 0.0), b))
            assert [o for _, o in sorted(mine[a])] == full[:k]


@pytest.mark.parametrize("k,hot", [(1, 256), (3, 5), (40, 256)])
def test_nearest_clusters_are_exact_and_few(spark, k, hot):
    """Pruned search equals the full join: a hot word that nearly every cluster holds, clusters without a word of
    their own, ties, and clusters alike in size only."""
    rnd = random.Random(k)
    rows = []
    for c in range(120):
        group = c // 6
        words = [f"g{group}w{rnd.randrange(6)}" for _ in range(8)] + [f"r{rnd.randrange(400)}"]
        if c % 10:
            words += ["hot"] * rnd.randint(1, 2)
        rows.append((f"c{c:03d}", " ".join(words)))
    rows += [("d0", "hot"), ("d1", "hot"), ("e0", "lonely"), ("e1", "")]
    clean = spark.createDataFrame(rows, "cluster_id string, title string")
    clusters = clean.select("cluster_id").distinct()
    bags = TS.cluster_bags(clean, clusters)
    sims = TS.cluster_similarity(bags, hot)
    near = TS.nearest_clusters(bags, k, hot).cache()
    order = ["cluster_id", "rank", "other"]
    want = [tuple(r[c] for c in (*order, "sim")) for r in TS.top_similar(sims, clusters, k).orderBy(*order).collect()]
    got = [tuple(r[c] for c in (*order, "sim")) for r in TS.top_similar(near, clusters, k).orderBy(*order).collect()]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(g[3] == pytest.approx(w[3]) for g, w in zip(got, want))
    if k < 5:  # the hot word joins nearly all clusters; few of these pairs are left
        assert near.count() < sims.count() / 5


def test_set_measures_and_numeric_norm(spark):
    df = spark.createDataFrame([("a b c", "b c d", 4.0, 5.0), ("x", "x", 0.0, 0.0)],
                               "s string, t string, u double, v double")
    a, b = F.split("s", " "), F.split("t", " ")
    r = df.select(S.set_jaccard(a, b).alias("j"), S.set_cosine(a, b).alias("c"),
                  S.set_dice(a, b).alias("d"), S.set_overlap(a, b).alias("o"),
                  S.abs_norm(F.col("u"), F.col("v")).alias("n"),
                  S.levenshtein_sim(F.col("s"), F.col("t")).alias("l"),
                  F.size(S.qgrams(F.col("s"), 3)).alias("q")).collect()
    assert r[0].j == pytest.approx(2 / 4) and r[0].c == pytest.approx(2 / 3)
    assert r[0].d == pytest.approx(4 / 6) and r[0].o == pytest.approx(2 / 3)
    assert r[0].n == pytest.approx(1 - 1 / 5) and r[1].n == 1.0
    assert r[0].l == pytest.approx(1 - 3 / 5) and r[0].q == 7


def test_qgrams_in_one_pass(spark):
    texts = ["", None, "a", "ab", "abc", "aaaa", "é😀x", "\u0000 \U0010ffff", "wörd word"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for q in (1, 2, 3):
        want = [[p[i:i + q] for i in range(len(p) - q + 1)] if t else [] for t in texts
                for p in ["#" * (q - 1) + (t or "") + "$" * (q - 1)]]
        r = df.select(S.qgrams(F.col("s"), q).alias("g"), S.qgram_codes(F.col("s"), q).alias("c")).collect()
        assert [x.g for x in r] == want

        def code(g):
            n = 0
            for ch in g:
                n = n << 21 | ord(ch)
            return n
        assert [x.c for x in r] == [[code(g) for g in w] for w in want]


def test_features_of_a_very_long_description(spark):
    """200,000 characters: token sets take one pass, not a pass a character."""
    import time
    from matchsmith.plans import features as FE
    long = "".join(chr(97 + i * i % 26) + (" " if i % 7 == 0 else "") for i in range(170_000))
    ent = spark.createDataFrame([(1, long), (2, long[:-50_000] + "x" * 50_000), (3, None)], "id long, description string")
    pairs = spark.createDataFrame([("a", 1, 2, long, long[:-50_000] + "x" * 50_000), ("b", 1, 3, long, None), ("c", 2, 2, "s", "s")],
                                  "pair_id string, id_left long, id_right long, description_left string, description_right string")
    plan = [("description", "jaccard_qgm3"), ("description", "cosine_dlm")]
    t0 = time.time()
    got = {r.pair_id: (r.description_jaccard_qgm3, r.description_cosine_dlm) for r in
           FE.pair_features(pairs, plan, ["pair_id"], entities=ent).collect()}
    assert time.time() - t0 < 60
    sets = [{p[i:i + 3] for i in range(len(p) - 2)} for p in ("##" + t + "$$" for t in (long, long[:-50_000] + "x" * 50_000))]
    assert got["a"][0] == pytest.approx(len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    assert got["b"] == (None, None) and got["c"] == (1.0, 1.0)
