"""Training-set construction: eligible offers, gold exclusion, seeded capped sampling of match
pairs within clusters and of non-match pairs across similar clusters.

Work that touches every offer (cleaning, de-duplication, eligibility, ranking, token bags) is
map-side or partially aggregated and range-partitioned, so a cluster holding a third of all
offers is still cut across many tasks. Pair work is bounded by the sample sizes (see
``operators.sampling``); cluster-level work is bounded by the number of gold clusters.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchsmith.functions import text as T
from matchsmith.operators.joins import bounded_broadcast
from matchsmith.operators.keys import random_ranks
from matchsmith.operators.sampling import (capped_sample, cross_of_index, draws, fetch_pair,
                                           index_of_cross, index_of_pair, pair_of_index, past_gold)
from matchsmith.session import checkpoint, materialize


@dataclass(frozen=True)
class SamplingConfig:
    positives: int = 15          # match pairs per cluster
    negatives: int = 45          # non-match pairs per owning cluster
    similar_clusters: int = 10   # most similar clusters paired with each cluster
    share: float = 1.0           # share of gold clusters used
    seed: int = 42
    stats_depth: int = 50        # ranks reported by similarity_by_rank
    min_words: int = 5           # title + description must have more words than this
    hot_token_clusters: int = 256  # clusters per token above which the token is salted


# ------------------------------------------------------------------------------ offers

def clean_offers(offers: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """Only the title is cleaned; the description stays raw."""
    return T.clean_column(offers, "title", "title", stop_words)


def dedup_offers(clean: DataFrame) -> DataFrame:
    """One offer per (cluster, title): most filled attributes, then highest id. Empty titles
    are dropped. A max over a struct is partially aggregated, so a hot title is no problem."""
    filled = T.filled_count([F.col("title"), F.col("description"), F.col("brand")])
    best = (clean.where(F.col("title").isNotNull() & (F.col("title") != ""))
            .groupBy("cluster_id", "title")
            .agg(F.max(F.struct(filled.alias("filled"), F.col("id"), F.col("description"),
                                F.col("brand"))).alias("w")))
    return best.select("w.id", "cluster_id", "title", "w.description", "w.brand",
                       F.col("w.filled").alias("filled"))


def eligible_offers(clean: DataFrame, min_words: int = 5) -> DataFrame:
    d = dedup_offers(clean)
    return d.where(T.more_words_than(T.combine([F.col("title"), F.col("description")]), min_words))


# ------------------------------------------------------------------------------ gold

def normalized_gold(gold: DataFrame) -> DataFrame:
    """Distinct unordered gold pairs (id_left < id_right)."""
    g = gold.select(F.least("id_left", "id_right").alias("id_left"),
                    F.greatest("id_left", "id_right").alias("id_right"))
    return g.where(F.col("id_left") != F.col("id_right")).distinct()


def gold_offers(clean: DataFrame, gold: DataFrame) -> DataFrame:
    ids = gold.select(F.explode(F.array("id_left", "id_right")).alias("id")).distinct()
    return clean.join(ids, "id", "left_semi")


def gold_clusters(clean: DataFrame, gold: DataFrame) -> DataFrame:
    return gold_offers(clean, gold).select("cluster_id").distinct()


def select_clusters(clusters: DataFrame, share: float, seed: int) -> DataFrame:
    """Keep round-half-even(share x count) clusters, chosen by seeded hash."""
    if share >= 1.0:
        return clusters
    n = clusters.count()
    keep = int(round(share * n))
    ranked = random_ranks(clusters, "cluster_id", seed, None, "_r")
    return ranked.where(F.col("_r") < keep).drop("_r")


def gold_titles(clean: DataFrame, gold: DataFrame) -> DataFrame:
    return gold_offers(clean, gold).select("title").distinct()


def ranked_offers(eligible: DataFrame, clusters: DataFrame, titles: DataFrame,
                  seed: int) -> DataFrame:
    """Eligible offers of the chosen clusters with the gold-title flag and a seeded dense rank
    per cluster, clean offers first. A stored table: the plans and the samples read it."""
    e = eligible.join(bounded_broadcast(clusters), "cluster_id", "left_semi")
    t = bounded_broadcast(titles.select("title", F.lit(True).alias("bad")))
    e = e.join(t, "title", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    # stored: ranking reads it five times, and whole texts are counted and compared to make it
    e = materialize(e.select("cluster_id", "id", "title", "bad"))
    r = random_ranks(e, "id", seed, ["cluster_id", "bad"])
    clean = e.where(~F.col("bad")).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_g"))
    r = r.join(bounded_broadcast(clean), "cluster_id", "left").withColumn(
        "rank", F.col("rank") + F.when(F.col("bad"), F.coalesce("_g", F.lit(0))).otherwise(F.lit(0)))
    return materialize(r.select("cluster_id", "id", "title", "bad", "rank"), ["rank"])


def _offer_side(ranked: DataFrame, suffix: str) -> DataFrame:
    return ranked.select(F.col("id").alias(f"id_{suffix}"),
                         F.col("cluster_id").alias(f"c_{suffix}"),
                         F.col("rank").alias(f"rank_{suffix}"),
                         F.col("bad").alias(f"bad_{suffix}"))


def gold_pairs_located(ranked: DataFrame, gold_norm: DataFrame) -> DataFrame:
    """Gold pairs whose two offers are both ranked, with their clusters and flags."""
    return (gold_norm.join(_offer_side(ranked, "left"), "id_left")
            .join(_offer_side(ranked, "right"), "id_right"))


# ------------------------------------------------------------------------------ positives

def positive_plan(ranked: DataFrame, gold_norm: DataFrame, n: int) -> DataFrame:
    """Per cluster: m offers, g good offers, candidate totals, sample size S, bad cap and the
    number of pairs the sample can reach."""
    counts = ranked.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("m"), F.sum(F.when(~F.col("bad"), 1).otherwise(0)).alias("g"))
    located = (gold_pairs_located(ranked, gold_norm).where(F.col("c_left") == F.col("c_right"))
               .withColumn("idx", index_of_pair(F.col("rank_left"), F.col("rank_right")))
               .withColumn("bad", F.col("bad_left") | F.col("bad_right")))
    # hand-labelled pairs of one cluster, as sorted indices
    g = located.groupBy(F.col("c_left").alias("cluster_id")).agg(
        F.array_sort(F.collect_list(F.when(~F.col("bad"), F.col("idx")))).alias("gold_clean"),
        F.array_sort(F.collect_list(F.when(F.col("bad"), F.col("idx")))).alias("gold_bad"))
    none = F.array().cast("array<bigint>")
    p = counts.join(g, "cluster_id", "left").withColumns({
        "gold_clean": F.coalesce("gold_clean", none), "gold_bad": F.coalesce("gold_bad", none)})
    m, gg = F.col("m").cast("long"), F.col("g").cast("long")
    half = lambda x: F.call_function("div", x * (x - 1), F.lit(2).cast("long"))
    p = p.withColumns({"T": half(m), "clean_pairs": half(gg)})
    p = p.withColumn("total", F.col("T") - F.size("gold_clean") - F.size("gold_bad"))
    p = p.withColumn("good_total", F.col("clean_pairs") - F.size("gold_clean"))
    p = p.withColumn("S", F.least(F.lit(n).cast("long"), F.col("total")))
    p = p.withColumn("cap", F.floor(F.col("S") / 2))
    p = p.withColumn("ach", F.least(F.col("S"), F.col("good_total") + F.least(
        F.col("cap"), F.col("total") - F.col("good_total"))))
    return p.withColumn("fallback", (F.col("ach") == 0) & (F.col("total") > 0))


def sample_positive_pairs(ranked: DataFrame, gold_norm: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``cluster_id, pos, id_left, id_right, bad``: the capped seeded sample per cluster."""
    plan = positive_plan(ranked, gold_norm, n).where(F.col("total") > 0)
    plan = plan.withColumns({"n_clean": F.col("good_total"), "n_bad": F.col("total") - F.col("good_total")})
    d = draws(plan, seed, ["cluster_id"])
    # bad pairs stand after the clean ones in the index of a cluster's pairs
    shifted = F.transform("gold_bad", lambda g: g - F.col("clean_pairs"))
    idx = F.when(F.col("bad"), past_gold(F.col("idx"), shifted) + F.col("clean_pairs")) \
        .otherwise(past_gold(F.col("idx"), F.col("gold_clean")))
    i, j = pair_of_index(F.col("idx"))
    d = d.withColumn("idx", idx).withColumns({"i": i, "j": j})
    d = capped_sample(d, ["cluster_id"])
    d = fetch_pair(d.select("cluster_id", "pos", "bad", "i", "j"), ranked, "cluster_id", "cluster_id")
    return checkpoint(d.select("cluster_id", "pos", F.least("id_i", "id_j").alias("id_left"),
                               F.greatest("id_i", "id_j").alias("id_right"), "bad"))


# ------------------------------------------------------------------------------ similarity

def cluster_bags(clean: DataFrame, clusters: DataFrame) -> DataFrame:
    """Word bags per cluster from the cleaned titles of all its offers: one bag per offer,
    summed (titles are not glued together)."""
    o = clean.join(bounded_broadcast(clusters), "cluster_id", "left_semi")
    return (o.select("cluster_id", F.explode(T.split_ws(F.coalesce("title", F.lit(""))))
                     .alias("token"))
            .groupBy("cluster_id", "token").agg(F.count(F.lit(1)).alias("cnt")))


def cluster_similarity(bags: DataFrame, hot_token_clusters: int = 256) -> DataFrame:
    """Multiset Jaccard of every two clusters that share a word, both directions:
    ``cluster_id, other, sim``. Inverted index on the token; tokens held by many clusters are
    salted so no task gets a hot token's whole cluster list twice."""
    sizes = bags.groupBy("cluster_id").agg(F.sum("cnt").alias("size"))
    freq = bags.groupBy("token").agg(F.count(F.lit(1)).alias("ct"))
    b = bags.join(freq, "token").withColumn(
        "K", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("ct") / hot_token_clusters)))
    a = b.select("token", F.col("cluster_id").alias("a"), F.col("cnt").alias("ca"),
                 F.pmod(F.xxhash64("cluster_id"), F.col("K")).alias("salt"))
    c = b.select("token", F.col("cluster_id").alias("b"), F.col("cnt").alias("cb"),
                 F.explode(F.sequence(F.lit(0).cast("long"), F.col("K") - 1)).alias("salt"))
    inter = (a.join(c, ["token", "salt"]).where(F.col("a") < F.col("b"))
             .groupBy("a", "b").agg(F.sum(F.least("ca", "cb")).alias("inter")))
    sa = sizes.select(F.col("cluster_id").alias("a"), F.col("size").alias("sa"))
    sb = sizes.select(F.col("cluster_id").alias("b"), F.col("size").alias("sb"))
    s = inter.join(sa, "a").join(sb, "b").withColumn(
        "sim", F.col("inter") / (F.col("sa") + F.col("sb") - F.col("inter")))
    one = s.select(F.col("a").alias("cluster_id"), F.col("b").alias("other"), "sim")
    two = s.select(F.col("b").alias("cluster_id"), F.col("a").alias("other"), "sim")
    return one.unionByName(two)


# Partners that a cluster's rarest words give at most to the first, rough round of ``nearest_clusters``.
ROUGH_WORDS, ROUGH_PARTNERS = 2, 64


def _shared_counts(pairs: DataFrame, bags: DataFrame, sizes: DataFrame) -> DataFrame:
    """``cluster_id, other, sim`` of the given pairs."""
    a = bags.select("cluster_id", "token", F.col("cnt").alias("ca"))
    b = bags.select(F.col("cluster_id").alias("other"), "token", F.col("cnt").alias("cb"))
    inter = (pairs.join(a, "cluster_id").join(b, ["other", "token"]).groupBy("cluster_id", "other")
             .agg(F.sum(F.least("ca", "cb")).alias("inter")))
    s = inter.join(sizes.withColumnRenamed("size", "sa"), "cluster_id").join(
        sizes.select(F.col("cluster_id").alias("other"), F.col("size").alias("sb")), "other")
    return s.select("cluster_id", "other", (F.col("inter") / (F.col("sa") + F.col("sb") - F.col("inter"))).alias("sim"))


def nearest_clusters(bags: DataFrame, k: int, hot_token_clusters: int = 256) -> DataFrame:
    """``cluster_id, other, sim``: for each cluster all others whose bag Jaccard is positive and at least its k-th
    best, so ``top_similar`` of it is exact, without the pairs of all clusters that share a word.

    1. A few partners that share a cluster's rarest words give a floor under its k-th best
       similarity: any partners do, so their number is bounded.
    2. A similarity of t or more needs t times the cluster's words in common, so a partner shares one of
       the cluster's rarest words that make up all but that many: only the postings of this
       prefix are read, frequent words drop out, and partners whose size alone rules t out are passed over.
    3. The partners found are compared on their whole bags.
    """
    bags = materialize(bags)
    sizes = bags.groupBy("cluster_id").agg(F.sum("cnt").alias("size"))
    freq = bags.groupBy("token").agg(F.count(F.lit(1)).alias("ct")).where("ct > 1")
    ranked = bags.join(freq, "token")
    rarest = Window.partitionBy("cluster_id").orderBy("ct", "token")
    upto = rarest.rowsBetween(Window.unboundedPreceding, -1)
    ranked = materialize(ranked.withColumns({"nth": F.row_number().over(rarest), "before": F.coalesce(F.sum("cnt").over(upto), F.lit(0))}))

    few = Window.partitionBy("token").orderBy("other")
    listed = (ranked.select("token", F.col("cluster_id").alias("other")).withColumn("at", F.row_number().over(few))
              .where(F.col("at") <= ROUGH_PARTNERS).drop("at"))
    rough = (ranked.where(F.col("nth") <= ROUGH_WORDS).select("cluster_id", "token").join(listed, "token")
             .where("cluster_id <> other").select("cluster_id", "other").distinct())
    best = Window.partitionBy("cluster_id").orderBy(F.col("sim").desc(), "other")
    floor = (_shared_counts(rough, bags, sizes).withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k)
             .select("cluster_id", F.col("sim").alias("floor")))

    # words that no other cluster holds are the rarest of all; they stand before the ranked ones
    alone = bags.join(freq, "token", "left_anti").groupBy("cluster_id").agg(F.sum("cnt").alias("alone"))
    prefix = (ranked.join(sizes, "cluster_id").join(alone, "cluster_id", "left").join(floor, "cluster_id", "left").na.fill(0, ["alone"]).na.fill(0.0, ["floor"])
              .withColumn("need", F.greatest(F.ceil(F.col("floor") * F.col("size") - F.lit(1e-9)), F.lit(1)))
              .where(F.col("alone") + F.col("before") <= F.col("size") - F.col("need")))
    salts = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("ct") / hot_token_clusters))
    left = prefix.select("token", "cluster_id", "size", "floor", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    right = ranked.join(sizes, "cluster_id").select("token", F.col("cluster_id").alias("other"), F.col("size").alias("other_size"),
                                                    F.pmod(F.xxhash64("cluster_id"), salts).alias("salt"))
    fits = F.least("size", "other_size") >= F.col("floor") * F.greatest("size", "other_size") - F.lit(1e-9)
    found = left.join(right, ["token", "salt"]).where((F.col("cluster_id") != F.col("other")) & fits).select("cluster_id", "other").distinct()
    sims = _shared_counts(found, bags, sizes).join(floor, "cluster_id", "left")
    return sims.where(F.col("sim") >= F.coalesce(F.col("floor"), F.lit(0.0)) - F.lit(1e-12)).drop("floor")


def top_similar(sims: DataFrame, clusters: DataFrame, k: int) -> DataFrame:
    """``cluster_id, rank, other, sim``: the k most similar other clusters (ties and zero
    similarity to the lowest cluster ids). Zero-similarity fill-up draws on the k+1 lowest
    cluster ids only, which always suffice."""
    w = Window.partitionBy("cluster_id").orderBy(F.col("sim").desc(), F.col("other"))
    top = sims.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    have = top.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("have"))
    lowest = [r[0] for r in clusters.select("cluster_id").orderBy("cluster_id")
              .limit(k + 1).collect()]
    if not lowest:
        return top
    short = (clusters.select("cluster_id").join(have, "cluster_id", "left")
             .na.fill(0, ["have"]).where(F.col("have") < k))
    fill = short.withColumn("other", F.explode(F.array(*[F.lit(x) for x in lowest])))
    fill = fill.where(F.col("other") != F.col("cluster_id"))
    fill = fill.join(top.select("cluster_id", "other"), ["cluster_id", "other"], "left_anti")
    fill = fill.withColumn("_r", F.row_number().over(
        Window.partitionBy("cluster_id").orderBy("other")))
    fill = fill.where(F.col("have") + F.col("_r") <= k).select(
        "cluster_id", (F.col("have") + F.col("_r")).alias("rank"), "other",
        F.lit(0.0).alias("sim"))
    return top.unionByName(fill)


def similarity_by_rank(sims: DataFrame, clusters: DataFrame, depth: int = 50) -> DataFrame:
    """Mean and population standard deviation of the similarity at rank 1..depth over all
    clusters; a cluster with fewer non-zero neighbours contributes zeros."""
    n_clusters = clusters.count()
    ranks = min(depth, max(n_clusters - 1, 0))
    w = Window.partitionBy("cluster_id").orderBy(F.col("sim").desc(), F.col("other"))
    top = sims.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= ranks)
    agg = top.groupBy("rank").agg(F.sum("sim").alias("s1"), F.sum(F.col("sim") ** 2).alias("s2"))
    spark = sims.sparkSession
    all_ranks = spark.range(1, ranks + 1).select(F.col("id").alias("rank"))
    res = all_ranks.join(agg, "rank", "left").na.fill(0.0, ["s1", "s2"])
    mean = F.col("s1") / F.lit(n_clusters)
    var = F.greatest(F.col("s2") / F.lit(n_clusters) - mean * mean, F.lit(0.0))
    return res.select(F.col("rank").alias("n_most_similar_cluster"),
                      F.round(mean, 6).alias("mean_sim"), F.round(F.sqrt(var), 6).alias("std_sim"))


def owned_cluster_pairs(top: DataFrame) -> DataFrame:
    """An unordered cluster pair found from both sides belongs to the lower cluster id."""
    e = top.select(F.col("cluster_id").alias("src"), "other")
    k = e.select("src", F.least("src", "other").alias("a"), F.greatest("src", "other").alias("b"))
    o = k.groupBy("a", "b").agg(F.min("src").alias("owner"))
    return o.select("owner", F.when(F.col("owner") == F.col("a"), F.col("b"))
                    .otherwise(F.col("a")).alias("other"))


# ------------------------------------------------------------------------------ negatives

def negative_plan(ranked: DataFrame, gold_norm: DataFrame, owned: DataFrame, n: int,
                  seed: int) -> DataFrame:
    """Per (owner, other) list: sizes, gold pairs between the two clusters, the equal share
    ``min_len`` of the owner, the list's slot in the owner's interleaving, S and cap."""
    m = ranked.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("m"), F.sum(F.when(~F.col("bad"), 1).otherwise(0)).alias("g"))
    mo = m.select(F.col("cluster_id").alias("owner"), F.col("m").alias("m_o"), F.col("g").alias("g_o"))
    mx = m.select(F.col("cluster_id").alias("other"), F.col("m").alias("m_x"), F.col("g").alias("g_x"))
    lists = (owned.join(mo, "owner", "left").join(mx, "other", "left")
             .na.fill(0, ["m_o", "m_x", "g_o", "g_x"]))
    located = gold_pairs_located(ranked, gold_norm).where(F.col("c_left") != F.col("c_right"))
    both = [located.select(F.col(f"c_{a}").alias("owner"), F.col(f"c_{b}").alias("other"), F.col(f"rank_{a}").alias("_i"),
                           F.col(f"rank_{b}").alias("_j"), (F.col("bad_left") | F.col("bad_right")).alias("_bad"))
            for a, b in (("left", "right"), ("right", "left"))]
    gold = both[0].unionByName(both[1]).join(lists.select("owner", "other", "m_x", "g_o", "g_x"), ["owner", "other"])
    gold = gold.withColumn("_idx", index_of_cross(*[F.col(c) for c in ("_i", "_j", "m_x", "g_o", "g_x")]))
    gold = gold.groupBy("owner", "other").agg(
        F.array_sort(F.collect_list(F.when(~F.col("_bad"), F.col("_idx")))).alias("gold_clean"),
        F.array_sort(F.collect_list(F.when(F.col("_bad"), F.col("_idx")))).alias("gold_bad"))
    none = F.array().cast("array<bigint>")
    lists = lists.join(gold, ["owner", "other"], "left").withColumns({
        "gold_clean": F.coalesce("gold_clean", none), "gold_bad": F.coalesce("gold_bad", none)})
    clean, every = F.col("g_o").cast("long") * F.col("g_x"), F.col("m_o").cast("long") * F.col("m_x")
    lists = lists.withColumns({"n_clean": clean - F.size("gold_clean"), "n_bad": every - clean - F.size("gold_bad")})
    lists = lists.withColumn("gold_between", F.size("gold_clean") + F.size("gold_bad"))
    lists = lists.withColumn("L", F.col("n_clean") + F.col("n_bad"))
    wo = Window.partitionBy("owner")
    lists = lists.withColumn("min_len", F.min("L").over(wo)) \
                 .withColumn("k_o", F.count(F.lit(1)).over(wo)) \
                 .withColumn("slot", F.row_number().over(
                     wo.orderBy(T.seeded_key(seed, "owner", "other"), "other")) - 1)
    lists = lists.withColumn("S", F.least(F.lit(n).cast("long"), F.col("k_o") * F.col("min_len")))
    return lists.withColumn("cap", F.floor(F.col("S") / 2))


def sample_negative_pairs(ranked: DataFrame, gold_norm: DataFrame, owned: DataFrame, n: int,
                          seed: int) -> DataFrame:
    """``owner, other, u, id_left, id_right, bad``: per owner, the capped seeded sample over
    the interleaved, equally cut lists of its cluster pairs."""
    plan = negative_plan(ranked, gold_norm, owned, n, seed).where(F.col("S") > 0)
    d = draws(plan, seed, ["owner", "other"]).where(F.col("pos") < F.col("min_len"))
    d = d.withColumn("u", F.col("pos") * F.col("k_o") + F.col("slot"))
    any_clean = F.max((~F.col("bad")).cast("int")).over(Window.partitionBy("owner"))
    d = d.withColumn("fallback", (F.col("S") == 1) & (any_clean == 0))
    d = capped_sample(d, ["owner"], pos="u")
    idx = F.when(F.col("bad"), past_gold(F.col("idx"), F.col("gold_bad"))).otherwise(past_gold(F.col("idx"), F.col("gold_clean")))
    i, j = cross_of_index(F.col("idx"), F.col("bad"), *[F.col(c) for c in ("m_x", "g_o", "g_x")])
    d = d.withColumn("idx", idx).withColumns({"i": i, "j": j})
    d = fetch_pair(d.select("owner", "other", "u", "bad", "i", "j"), ranked, "owner", "other")
    return checkpoint(d.select("owner", "other", "u", F.col("id_i").alias("id_left"), F.col("id_j").alias("id_right"), "bad"))


# ------------------------------------------------------------------------------ assembly

@dataclass
class TrainingSetParts:
    clean: DataFrame
    eligible: DataFrame
    gold_norm: DataFrame
    clusters: DataFrame
    ranked: DataFrame
    # stage outputs already computed for these parts (similarity, samples), by parameters
    done: dict = field(default_factory=dict)

    def once(self, key: tuple, build):
        if key not in self.done:
            self.done[key] = build()
        return self.done[key]


def prepare(offers: DataFrame, gold: DataFrame, cfg: SamplingConfig,
            stop_words: list[str] | None = None) -> TrainingSetParts:
    eligible = eligible_offers(clean_offers(offers, stop_words), cfg.min_words)
    clean = materialize(clean_offers(offers.select("id", "cluster_id", "title"), stop_words))  # titles are cleaned once for all that follows
    gnorm = checkpoint(normalized_gold(gold))
    clusters = checkpoint(select_clusters(gold_clusters(clean, gnorm), cfg.share, cfg.seed))
    titles = gold_titles(clean, gnorm)
    ranked = ranked_offers(eligible, clusters, titles, cfg.seed)
    return TrainingSetParts(clean, eligible, gnorm, clusters, ranked)


def positive_sample(parts: TrainingSetParts, cfg: SamplingConfig) -> DataFrame:
    """Sampled match pairs with their sequence position and gold-title flag."""
    return parts.once(("positives", cfg.positives, cfg.seed),
                      lambda: sample_positive_pairs(parts.ranked, parts.gold_norm, cfg.positives, cfg.seed))


def positives(parts: TrainingSetParts, cfg: SamplingConfig) -> DataFrame:
    return positive_sample(parts, cfg).select("cluster_id", "id_left", "id_right", F.lit(1).alias("label"))


def all_similarities(parts: TrainingSetParts, cfg: SamplingConfig) -> DataFrame:
    """Every two clusters that share a word (a report's input; sampling uses ``similar``)."""
    return parts.once(("similarities", cfg.hot_token_clusters), lambda: checkpoint(
        cluster_similarity(cluster_bags(parts.clean, parts.clusters), cfg.hot_token_clusters)))


def similar(parts: TrainingSetParts, cfg: SamplingConfig, k: int | None = None) -> DataFrame:
    """The ``k`` most similar other clusters of each (``top_similar``), without all pairs."""
    k = k or cfg.similar_clusters
    return parts.once(("similar", k, cfg.hot_token_clusters), lambda: checkpoint(
        top_similar(nearest_clusters(cluster_bags(parts.clean, parts.clusters), k, cfg.hot_token_clusters), parts.clusters, k)))


def owned_pairs(parts: TrainingSetParts, cfg: SamplingConfig) -> DataFrame:
    return parts.once(("owned", cfg.similar_clusters, cfg.hot_token_clusters),
                      lambda: checkpoint(owned_cluster_pairs(similar(parts, cfg))))


def negative_sample(parts: TrainingSetParts, cfg: SamplingConfig) -> DataFrame:
    """Sampled non-match pairs with owner, other cluster, interleaved position and flag."""
    owned = owned_pairs(parts, cfg)
    return parts.once(("negatives", cfg.similar_clusters, cfg.negatives, cfg.seed),
                      lambda: sample_negative_pairs(parts.ranked, parts.gold_norm, owned,
                                                    cfg.negatives, cfg.seed))


def negatives(parts: TrainingSetParts, cfg: SamplingConfig) -> DataFrame:
    return negative_sample(parts, cfg).select(F.col("owner").alias("cluster_id"), F.col("other").alias("other_cluster_id"),
                    "id_left", "id_right", F.lit(0).alias("label"))


def attach_titles(pairs: DataFrame, clean: DataFrame) -> DataFrame:
    """Fetch both offers' titles of every pair (two equi-joins on the offer id)."""
    a = clean.select(F.col("id").alias("id_left"), F.col("title").alias("title_left"))
    b = clean.select(F.col("id").alias("id_right"), F.col("title").alias("title_right"))
    return pairs.join(a, "id_left").join(b, "id_right")


# Training-set settings: positives - negatives - similar clusters - cluster share.
TRAINING_SET_SETTINGS = ["1-3-10-1.0", "3-9-10-1.0", "15-45-10-1.0", "50-150-10-1.0"]


def parse_setting(label: str, base: SamplingConfig = SamplingConfig()) -> SamplingConfig:
    p, n, k, share = label.split("-")
    return SamplingConfig(positives=int(float(p)), negatives=int(float(n)),
                          similar_clusters=int(float(k)), share=float(share), seed=base.seed,
                          min_words=base.min_words, hot_token_clusters=base.hot_token_clusters)


def training_set_grid(offers: DataFrame, gold: DataFrame,
                      settings: list[str] = TRAINING_SET_SETTINGS,
                      base: SamplingConfig = SamplingConfig()) -> DataFrame:
    """Positives + negatives for every setting, with a ``setting`` column. Settings that share
    the cluster share and seed reuse one set of ranked offers, and one similarity table per
    number of similar clusters."""
    prepared: dict = {}
    out = None
    for label in settings:
        cfg = parse_setting(label, base)
        pk = (cfg.share, cfg.seed, cfg.min_words)
        if pk not in prepared:
            prepared[pk] = prepare(offers, gold, cfg)
        parts = prepared[pk]
        pos = positives(parts, cfg)
        neg = negatives(parts, cfg).drop("other_cluster_id")
        part = pos.unionByName(neg).withColumn("setting", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out
