"""Registered queries: one Spark DataFrame builder per operator of the inventory, with the
DuckDB SQL that computes the same rows by brute force (``ORACLE``).

Every builder reads the driver tables under ``sf_dir`` (through ``sources.fixtures``) and runs
over whole tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchsmith.functions import text as T
from matchsmith.plans import oracle as O
from matchsmith.plans import training_sets as TS
from matchsmith.session import read_table, session_memo
from matchsmith.sources import fixtures as FX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CFG = TS.SamplingConfig()


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _docs(spark, sf):
    return read_table(spark, sf, "documents")


# ============================================================================ 1. text

@register("clean_tokens", f"""
SELECT doc_id, len(tk) AS n_tokens, array_to_string(tk, ' ') AS tokens
FROM (SELECT doc_id, {O.tokens_sql('text')} AS tk FROM documents) t""")
def clean_tokens(spark, sf):
    d = _docs(spark, sf).select("doc_id", T.tokenize(F.col("text")).alias("tk"))
    return d.select("doc_id", F.size("tk").cast("long").alias("n_tokens"),
                    F.array_join("tk", " ").alias("tokens"))


@register("clean_text", f"""
SELECT doc_id, {O.clean_sql('text')} AS clean FROM documents""")
def clean_text(spark, sf):
    d = _docs(spark, sf).select("doc_id", "text")
    return T.clean_column(d, "text", "clean").select("doc_id", "clean")


@register("alnum_text", r"""
SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[^0-9a-zA-Z]+', ' ', 'g')) AS alnum
FROM documents""")
def alnum_text(spark, sf):
    return _docs(spark, sf).select("doc_id", T.alnum_only(F.col("text")).alias("alnum"))


_W = r"[\p{L}\p{N}_]"
_NAME_SQL_CORE = (
    "trim(lower(regexp_replace(regexp_replace(coalesce(name, ''), "
    + O.q(_W + r"+:/{2}[\p{Nd}" + _W[1:-1] + r"-]+(\.[\p{Nd}" + _W[1:-1] + r"-]+)*(?:(?:/[^\s/]*))*")
    + ", '', 'g'), " + O.q(r"[^\p{L}\p{N}_]+") + ", ' ', 'g')))")
_NAME_SQL = (
    "trim(array_to_string(list_transform(string_split(regexp_replace(" + _NAME_SQL_CORE + ", "
    + O.q(r"([A-Za-z]+[\p{Nd}@]+[\p{L}\p{N}_@]*|[\p{Nd}@]+[A-Za-z]+[\p{L}\p{N}_@]*)")
    + ", 'LETTERNUMBER', 'g'), ' '), lambda t: CASE WHEN regexp_full_match(t, "
    + O.q(r"\p{Nd}+") + ") THEN 'NUMBER' ELSE t END), ' '))")


def _names(spark, sf):
    d = _docs(spark, sf).select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
                                .alias("key"), F.col("text").alias("name"))
    p = read_table(spark, sf, "pages").select(
        F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("key"),
        F.concat(F.lit("Offer 2x "), F.col("url"), F.lit(" item-42 at 10 EUR")).alias("name"))
    return d.unionByName(p)


@register("normalize_name", f"""
WITH names AS (
  SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS key, text AS name FROM documents
  UNION ALL
  SELECT 'page/' || CAST(page_id AS VARCHAR), 'Offer 2x ' || url || ' item-42 at 10 EUR'
  FROM pages)
SELECT key, CASE WHEN length(n) = 0 THEN 'NONE' ELSE n END AS name_norm
FROM (SELECT key, {_NAME_SQL} AS n FROM names) t""")
def normalize_name(spark, sf):
    return _names(spark, sf).select("key", T.normalize_name(F.col("name")).alias("name_norm"))


_COMBOS = {"t": ["title"], "td": ["title", "description"],
           "tdb": ["title", "description", "brand"]}


@register("combined_features", O.with_fixtures() + "\nSELECT pair_id, " + ", ".join(
    f"trim(concat_ws(' ', {', '.join(f'coalesce({c}_{side}, {chr(39)}{chr(39)})' for c in cols)}))"
    f" AS {name}_{side}"
    for name, cols in _COMBOS.items() for side in ("left", "right")) + " FROM pairs_v")
def combined_features(spark, sf):
    p = FX.pairs(spark, sf)
    return p.select("pair_id", *[
        T.combine([F.col(f"{c}_{side}") for c in cols]).alias(f"{name}_{side}")
        for name, cols in _COMBOS.items() for side in ("left", "right")])


@register("pair_text_roundtrip", O.with_fixtures() + """
SELECT line, CAST(split_part(line, '#', 1) AS BIGINT) AS id_left,
       CAST(split_part(line, '#', 2) AS BIGINT) AS id_right,
       CAST(split_part(line, '#', 3) AS INTEGER) AS label
FROM (SELECT CAST(id_left AS VARCHAR) || '#' || CAST(id_right AS VARCHAR) || '#'
             || CAST(label AS VARCHAR) AS line FROM pairs_v) t""")
def pair_text_roundtrip(spark, sf):
    from matchsmith.sources.io import format_pair_lines, parse_pair_lines
    lines = format_pair_lines(FX.pair_labels(spark, sf))
    return parse_pair_lines(lines)


# ============================================================================ 2. positives

_TR = O.training_ctes(CFG.seed, CFG.min_words)


def _parts(spark, sf, cfg=CFG):
    return session_memo(spark, ("parts", sf, cfg),
                        lambda: TS.prepare(FX.offers(spark, sf), FX.gold(spark, sf), cfg))


@register("offer_dedup", O.with_fixtures(*_TR[:2]) +
          "\nSELECT id, cluster_id, title FROM dedup")
def offer_dedup(spark, sf):
    clean = TS.clean_offers(FX.offers(spark, sf))
    return TS.dedup_offers(clean).select("id", "cluster_id", "title")


@register("eligible_offers", O.with_fixtures(*_TR[:3]) +
          "\nSELECT id, cluster_id, title FROM eligible")
def eligible_offers(spark, sf):
    clean = TS.clean_offers(FX.offers(spark, sf))
    return TS.eligible_offers(clean, CFG.min_words).select("id", "cluster_id", "title")


@register("gold_clusters", O.with_fixtures(*_TR[:7]) + "\nSELECT cluster_id FROM gclusters")
def gold_clusters(spark, sf):
    clean = TS.clean_offers(FX.offer_view(spark, sf))
    return TS.gold_clusters(clean, TS.normalized_gold(FX.gold(spark, sf)))


@register("cluster_share", O.with_fixtures(*_TR[:7]) + f"""
SELECT cluster_id FROM (
  SELECT cluster_id, row_number() OVER (ORDER BY {O.seeded(CFG.seed, 'cluster_id')}, cluster_id)
         AS r, count(*) OVER () AS n FROM gclusters) t
WHERE r <= round_even(0.5 * n, 0)""")
def cluster_share(spark, sf):
    clean = TS.clean_offers(FX.offer_view(spark, sf))
    c = TS.gold_clusters(clean, TS.normalized_gold(FX.gold(spark, sf)))
    return TS.select_clusters(c, 0.5, CFG.seed)


@register("positive_candidate_counts", O.with_fixtures(*_TR) + """,
pairs_all AS (SELECT a.cluster_id, least(a.id, b.id) AS id_left, greatest(a.id, b.id) AS id_right,
                     (a.bad OR b.bad) AS bad
              FROM ranked a JOIN ranked b ON a.cluster_id = b.cluster_id AND a.id < b.id),
c AS (SELECT p.* FROM pairs_all p ANTI JOIN gnorm g
      ON g.id_left = p.id_left AND g.id_right = p.id_right)
SELECT s.cluster_id, s.m AS offers, CAST(coalesce(x.total, 0) AS BIGINT) AS candidates,
       CAST(coalesce(x.good, 0) AS BIGINT) AS clean_candidates
FROM msize s LEFT JOIN (SELECT cluster_id, count(*) AS total,
                               sum(CASE WHEN NOT bad THEN 1 ELSE 0 END) AS good
                        FROM c GROUP BY ALL) x USING (cluster_id)""")
def positive_candidate_counts(spark, sf):
    """Candidate match pairs per cluster (after gold exclusion), counted without listing them."""
    parts = _parts(spark, sf)
    p = TS.positive_plan(parts.ranked, parts.gold_norm, CFG.positives)
    return p.select("cluster_id", F.col("m").alias("offers"),
                    F.col("total").alias("candidates"),
                    F.col("good_total").alias("clean_candidates"))


_POS = _TR + O.positives_ctes(CFG.positives)


@register("sampled_positives", O.with_fixtures(*_POS) +
          "\nSELECT cluster_id, id_left, id_right, 1 AS label FROM psample")
def sampled_positives(spark, sf):
    return TS.positives(_parts(spark, sf), CFG)


@register("pair_titles", O.with_fixtures(*_POS) + """
SELECT s.id_left, s.id_right, a.title AS title_left, b.title AS title_right
FROM psample s JOIN clean a ON a.id = s.id_left JOIN clean b ON b.id = s.id_right""")
def pair_titles(spark, sf):
    parts = _parts(spark, sf)
    s = TS.positives(parts, CFG)
    return TS.attach_titles(s, parts.clean).select("id_left", "id_right", "title_left",
                                                   "title_right")


# ============================================================================ 3. negatives

_SIM = _TR + O.similarity_ctes()


@register("title_similarity", O.with_fixtures() + """,
tl AS (SELECT pair_id, unnest(""" + O.split_ws_sql(O.clean_sql("title_left")) + """) AS token
       FROM pairs_v),
tr AS (SELECT pair_id, unnest(""" + O.split_ws_sql(O.clean_sql("title_right")) + """) AS token
       FROM pairs_v),
bl AS (SELECT pair_id, token, count(*) AS cnt FROM tl GROUP BY ALL),
br AS (SELECT pair_id, token, count(*) AS cnt FROM tr GROUP BY ALL),
sl AS (SELECT pair_id, sum(cnt) AS n FROM bl GROUP BY ALL),
sr AS (SELECT pair_id, sum(cnt) AS n FROM br GROUP BY ALL),
it AS (SELECT bl.pair_id, sum(least(bl.cnt, br.cnt)) AS inter FROM bl JOIN br
       ON bl.pair_id = br.pair_id AND bl.token = br.token GROUP BY ALL)
SELECT p.pair_id,
       round(CASE WHEN coalesce(sl.n, 0) + coalesce(sr.n, 0) = 0 THEN 1.0
                  ELSE coalesce(it.inter, 0) / (coalesce(sl.n, 0) + coalesce(sr.n, 0)
                       - coalesce(it.inter, 0)) END, 6) AS sim
FROM pairs_v p LEFT JOIN sl USING (pair_id) LEFT JOIN sr USING (pair_id)
LEFT JOIN it USING (pair_id)""")
def title_similarity(spark, sf):
    from matchsmith.functions.similarity import multiset_jaccard
    p = FX.pair_rows(spark, sf).select("pair_id", F.col("title_left").alias("a"),
                                   F.col("title_right").alias("b"))
    p = T.clean_columns(p, ["a", "b"])
    # titles are short: their bags are compared inside the row, without a shuffle
    words = [T.split_ws(F.coalesce(F.col(c), F.lit(""))) for c in ("a", "b")]
    return p.select("pair_id", F.round(multiset_jaccard(*words), 6).alias("sim"))


@register("cluster_similarity", O.with_fixtures(*_SIM) +
          "\nSELECT cluster_id, other, round(sim, 6) AS sim FROM simall WHERE sim > 0")
def cluster_similarity(spark, sf):
    parts = _parts(spark, sf)
    sims = TS.all_similarities(parts, CFG)
    return sims.select("cluster_id", "other", F.round("sim", 6).alias("sim"))


@register("similar_clusters", O.with_fixtures(*_SIM) + f"""
SELECT cluster_id, rank, other, round(sim, 6) AS sim FROM simrank
WHERE rank <= {CFG.similar_clusters}""")
def similar_clusters(spark, sf):
    parts = _parts(spark, sf)
    top = TS.similar(parts, CFG)
    return top.select("cluster_id", F.col("rank").cast("long").alias("rank"), "other",
                      F.round("sim", 6).alias("sim"))


_NEG = _SIM + O.negatives_ctes(CFG.negatives, CFG.similar_clusters, CFG.seed)


@register("owned_cluster_pairs", O.with_fixtures(*_NEG[:-7]) +
          "\nSELECT owner, other FROM owned2")
def owned_cluster_pairs(spark, sf):
    parts = _parts(spark, sf)
    return TS.owned_pairs(parts, CFG)


@register("negative_list_sizes", O.with_fixtures(*_NEG[:-4]) +
          "\nSELECT owner, other, L AS candidates, min_len AS equal_share FROM lists2")
def negative_list_sizes(spark, sf):
    """Candidate non-match pairs per owned cluster pair and the owner's equal share."""
    parts = _parts(spark, sf)
    owned = TS.owned_pairs(parts, CFG)
    p = TS.negative_plan(parts.ranked, parts.gold_norm, owned, CFG.negatives, CFG.seed)
    return p.select("owner", "other", F.col("L").alias("candidates"),
                    F.col("min_len").alias("equal_share"))


@register("sampled_negatives", O.with_fixtures(*_NEG) +
          "\nSELECT cluster_id, other_cluster_id, id_left, id_right, 0 AS label FROM nsample")
def sampled_negatives(spark, sf):
    return TS.negatives(_parts(spark, sf), CFG)


@register("similarity_by_rank", O.with_fixtures(*_SIM) + f"""
SELECT rank AS n_most_similar_cluster, round(avg(sim), 6) AS mean_sim,
       round(stddev_pop(sim), 6) AS std_sim
FROM simrank WHERE rank <= {CFG.stats_depth} GROUP BY rank""")
def similarity_by_rank(spark, sf):
    parts = _parts(spark, sf)
    sims = TS.nearest_clusters(TS.cluster_bags(parts.clean, parts.clusters), CFG.stats_depth, CFG.hot_token_clusters)
    return TS.similarity_by_rank(sims, parts.clusters, CFG.stats_depth)


def _load_all() -> None:
    from matchsmith.plans import catalog_io, catalog_ml, catalog_more  # noqa: F401  (register queries)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)
