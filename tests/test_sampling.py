import hashlib
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from matchsmith.operators import sampling as SM
from matchsmith.operators.sampling import capped_sample
from matchsmith.plans import training_sets as TS


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def offers_fixture(spark, seed=7):
    """Hand-made offers with the edge rows of FIXTURES.md: null and empty titles, two offers
    with one title in one cluster, a cluster with one offer, a cluster where every pair
    touches a gold title, a gold pair stored in reverse order."""
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "zeta", "eta",
             "theta", "iota", "lambda", "mu", "nu", "xi", "pi", "rho", "tau"]
    rows = []
    oid = 0
    for c in range(8):
        size = [1, 2, 3, 6, 9, 14, 25, 40][c]
        for k in range(size):
            oid += 1
            title = " ".join(rnd.choice(words) for _ in range(rnd.randint(2, 6)))
            desc = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 8)))
            rows.append((oid, f"c{c}", title, desc, "b"))
    rows.append((1000, "c6", None, "a b c d e f g", "b"))
    rows.append((1001, "c6", "", "a b c d e f g", "b"))
    rows.append((1002, "c6", rows[-3][2], "more words here to make it long enough", ""))
    rows.append((1003, "c2", "the and of", "x y z w v u t", "b"))      # title all stop words
    df = spark.createDataFrame(rows, "id long, cluster_id string, title string, "
                                     "description string, brand string")
    ids_by_c = {}
    for r in rows:
        ids_by_c.setdefault(r[1], []).append(r[0])
    gold = []
    for c, ids in sorted(ids_by_c.items()):
        if len(ids) >= 2:
            gold.append((ids[1], ids[0]))              # stored in reverse order
    gold.append((ids_by_c["c3"][2], ids_by_c["c5"][1]))
    # c4: every offer's title is a gold title
    for i in ids_by_c["c4"]:
        gold.append((i, ids_by_c["c7"][0]))
    g = spark.createDataFrame([(a, b) for a, b in gold], "id_left long, id_right long")
    return df, g


def walked(pairs, seed, *keys):
    """(pos, pair, bad) of one group's pairs, given in index order as (pair, bad)."""
    sizes = {x: sum(b == x for _, b in pairs) for x in (False, True)}
    marks = []
    for bad in (False, True):
        own = [p for p, b in pairs if b == bad]
        h = int(md5("|".join([str(seed), *keys, "true" if bad else "false"]))[:15], 16)
        for t in range(len(own)):
            at = (SM.STRIDES[h % 4] % len(own) * t + (h // 4) % len(own)) % len(own)
            marks.append((Fraction(2 * t + 1, sizes[bad]), bad, own[at]))
    marks.sort(key=lambda m: m[:2])  # spread evenly, clean first on ties
    return [(pos, pair, bad) for pos, (_, bad, pair) in enumerate(marks)]


def brute_positives(spark, offers, gold, n, seed=42):
    clean = TS.clean_offers(offers)
    elig = {r.id: r for r in TS.eligible_offers(clean).collect()}
    cl = {r.id: r for r in clean.collect()}
    gset = {(min(r.id_left, r.id_right), max(r.id_left, r.id_right))
            for r in gold.collect() if r.id_left != r.id_right}
    gold_ids = {x for p in gset for x in p}
    gclusters = {cl[i].cluster_id for i in gold_ids if i in cl}
    gtitles = {cl[i].title for i in gold_ids if i in cl}
    out = set()
    for c in sorted(gclusters):
        bad = lambda i: elig[i].title in gtitles
        ids = sorted((i for i, r in elig.items() if r.cluster_id == c),
                     key=lambda i: (bad(i), md5(f"{seed}|{i}"), i))
        pairs = [((min(a, b), max(a, b)), bad(a) or bad(b)) for j, b in enumerate(ids) for a in ids[:j]]
        cands = walked([x for x in pairs if x[0] not in gset], seed, c)
        if not cands:
            continue
        S = min(n, len(cands))
        cap = S // 2
        kept, nb = [], 0
        for pos, key, is_bad in cands:
            if is_bad:
                nb += 1
                if nb > cap:
                    continue
            kept.append(key)
        kept = kept[:S]
        if not kept:
            kept = [cands[0][1]]
        out |= {(c, a, b) for a, b in kept}
    return out


@pytest.mark.parametrize("n", [1, 3, 15, 50, 1000])
def test_positive_sample_matches_brute_force(spark, n):
    offers, gold = offers_fixture(spark)
    cfg = TS.SamplingConfig(positives=n)
    parts = TS.prepare(offers, gold, cfg)
    got = {(r.cluster_id, r.id_left, r.id_right) for r in TS.positives(parts, cfg).collect()}
    assert got == brute_positives(spark, offers, gold, n)


def test_draws_are_a_permutation(spark):
    """All draws of a group give every pair of both ranges once and every merged place once."""
    groups = [(f"g{a}-{b}", a, b, a + b, a + b) for a in (0, 1, 2, 5, 7, 36) for b in (0, 1, 3, 4, 12, 35) if a + b]
    df = spark.createDataFrame(groups, "g string, n_clean long, n_bad long, S long, cap long")
    rows = SM.draws(df, 1, ["g"]).collect()
    for g, a, b, n, _ in groups:
        mine = [r for r in rows if r.g == g]
        assert sorted(r.pos for r in mine) == list(range(n))
        for bad, size in ((False, a), (True, b)):
            assert sorted(r.idx for r in mine if r.bad == bad) == list(range(size))


def test_pair_indices_invert(spark):
    c = F.col
    rows = [(i, j) for j in range(9) for i in range(j)] + [(10 ** 6, 10 ** 6 + 1), (5, 94_906_267), (94_906_266, 94_906_267)]
    df = spark.createDataFrame(rows, "a long, b long").withColumn("idx", SM.index_of_pair(c("b"), c("a")))
    i, j = SM.pair_of_index(c("idx"))
    assert df.where((i != c("a")) | (j != c("b"))).count() == 0
    assert sorted(r.idx for r in df.where("b < 9").collect()) == list(range(36))
    for m_o, g_o, m_x, g_x in ((3, 2, 4, 1), (2, 0, 3, 3), (4, 4, 2, 2), (3, 3, 2, 0)):
        cells = [(i, j, m_x, g_o, g_x) for i in range(m_o) for j in range(m_x)]
        df = spark.createDataFrame(cells, "i long, j long, m_x long, g_o long, g_x long")
        names = [c(x) for x in ("m_x", "g_o", "g_x")]
        df = df.withColumn("idx", SM.index_of_cross(c("i"), c("j"), *names)).withColumn("bad", (c("i") >= c("g_o")) | (c("j") >= c("g_x")))
        i, j = SM.cross_of_index(c("idx"), c("bad"), *names)
        assert df.where((i != c("i")) | (j != c("j"))).count() == 0
        assert sorted(r.idx for r in df.where("not bad").collect()) == list(range(g_o * g_x))
        assert sorted(r.idx for r in df.where("bad").collect()) == list(range(m_o * m_x - g_o * g_x))


def test_gold_pairs_are_passed_over(spark):
    df = spark.range(7).select(SM.past_gold(F.col("id"), F.array(*[F.lit(x).cast("long") for x in (0, 2, 3, 9)])).alias("x"))
    assert sorted(r.x for r in df.collect()) == [1, 4, 5, 6, 7, 8, 10]


def test_offer_degrees_look_uniform(spark):
    """Over many clusters a pair is drawn as often as any other: no offer is favoured by its rank."""
    n_clusters, m, take = 400, 12, 11
    df = spark.createDataFrame([(f"c{k}", m * (m - 1) // 2, 0, take, 0) for k in range(n_clusters)],
                               "g string, n_clean long, n_bad long, S long, cap long")
    i, j = SM.pair_of_index(F.col("idx"))
    rows = SM.draws(df, 3, ["g"]).select("g", i.alias("i"), j.alias("j")).collect()
    degree, pairs = [0] * m, {}
    for r in rows:
        degree[r.i] += 1
        degree[r.j] += 1
        pairs[r.i, r.j] = pairs.get((r.i, r.j), 0) + 1
    expected = 2 * n_clusters * take / m
    assert all(abs(d - expected) < 0.12 * expected for d in degree)
    assert len(pairs) == 66 and max(pairs.values()) < 2 * n_clusters * take / 66


def test_rare_clean_pairs_need_few_draws(spark):
    """1,500 offers of which two have no gold title: one round of at most 2 S draws, the clean pair kept."""
    rows = [("c", k, 100 + k, k >= 2) for k in range(1500)]
    ranked = spark.createDataFrame(rows, "cluster_id string, rank long, id long, bad boolean").withColumn("title", F.lit("t"))
    gold = spark.createDataFrame([], "id_left long, id_right long")
    plan = TS.positive_plan(ranked, gold, 15).withColumns({"n_clean": F.col("good_total"), "n_bad": F.col("total") - F.col("good_total")})
    assert SM.draws(plan, 42, ["cluster_id"]).count() <= 30
    got = TS.sample_positive_pairs(ranked, gold, 15).collect()
    assert len(got) == 8 and (100, 101) in {(r.id_left, r.id_right) for r in got}


def test_sample_is_deterministic_across_partitionings(spark):
    offers, gold = offers_fixture(spark)
    cfg = TS.SamplingConfig(positives=3)
    res = []
    for parts_n in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", parts_n)
        p = TS.prepare(offers.repartition(int(parts_n)), gold, cfg)
        res.append({tuple(r) for r in TS.positives(p, cfg).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert res[0] == res[1]


def test_capped_sample_sizes(spark):
    rows = []
    for g, (good, bad, n) in enumerate([(10, 10, 6), (1, 9, 6), (0, 5, 1), (3, 0, 5)]):
        k = 0
        for _ in range(good):
            rows.append((g, k, False)); k += 1
        for _ in range(bad):
            rows.append((g, k, True)); k += 1
    df = spark.createDataFrame(rows, "g int, pos long, bad boolean")
    plan = {0: (6, 3), 1: (6, 3), 2: (1, 0), 3: (3, 1)}
    df = df.withColumn("S", F.udf(lambda g: plan[g][0], "long")("g")) \
        .withColumn("cap", F.udf(lambda g: plan[g][1], "long")("g")) \
        .withColumn("fallback", F.col("g") == 2)
    got = {r.g: r.n for r in capped_sample(df, ["g"]).groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 6, 1: 4, 2: 1, 3: 3}


@pytest.mark.parametrize("n", [1, 45])
def test_negative_sample_rules(spark, n):
    offers, gold = offers_fixture(spark)
    cfg = TS.SamplingConfig(negatives=n, similar_clusters=3)
    parts = TS.prepare(offers, gold, cfg)
    rows = {tuple(r) for r in TS.negatives(parts, cfg).collect()}
    g = {(min(r.id_left, r.id_right), max(r.id_left, r.id_right)) for r in gold.collect()}
    pairs = {(min(x[2], x[3]), max(x[2], x[3])) for x in rows}
    assert rows and len(pairs) == len(rows) and not pairs & g
    cluster = {r.id: r.cluster_id for r in offers.collect()}
    assert all(cluster[x[2]] == x[0] != x[1] == cluster[x[3]] for x in rows)
    flags = TS.negative_sample(parts, cfg).groupBy("owner").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("int")).alias("bad"))
    assert all(r.n <= n and (r.bad <= n // 2 or r.n == 1) for r in flags.collect())


def test_capped_sample_matches_rule_on_random_groups(spark):
    """Keep bad candidates up to the cap, then the first S by position; fallback groups keep
    their first candidate."""
    rnd = random.Random(11)
    rows, expected = [], set()
    for g in range(300):
        n = rnd.randint(1, 40)
        positions = rnd.sample(range(1000), n)
        bad = {p: rnd.random() < rnd.choice([0.1, 0.5, 0.9, 1.0]) for p in positions}
        size = min(rnd.randint(1, 20), n)
        cap = size // 2
        fallback = size == 1 and all(bad.values())
        for p in positions:
            rows.append((g, p, bad[p], size, cap, fallback))
        order = sorted(positions)
        if fallback:
            expected.add((g, order[0]))
            continue
        kept, nb = [], 0
        for p in order:
            if bad[p]:
                nb += 1
                if nb > cap:
                    continue
            kept.append(p)
        expected |= {(g, p) for p in kept[:size]}
    df = spark.createDataFrame(rows, "g int, pos long, bad boolean, S long, cap long, fallback boolean")
    got = {(r.g, r.pos) for r in capped_sample(df, ["g"]).collect()}
    assert got == expected
