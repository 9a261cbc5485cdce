"""Further registered queries: set assembly and reports, noise / splits / folds, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchsmith.functions import text as T
from matchsmith.operators import metrics as M
from matchsmith.operators import shape as SH
from matchsmith.operators import splits as SP
from matchsmith.operators.joins import fk_violations, key_violations
from matchsmith.plans import oracle as O
from matchsmith.plans import training_sets as TS
from matchsmith.plans.catalog import _NAME_SQL, _NEG, CFG, _parts, register
from matchsmith.session import read_table
from matchsmith.sources import fixtures as FX

_SPLITS_CTE = """splits_v AS (
  SELECT p.*, 'test' AS split FROM pairs_v p WHERE pair_id IN (SELECT pair_id FROM gold_v)
  UNION ALL
  SELECT p.*, CASE WHEN pair_id IN (SELECT pair_id FROM valid_ids_v) THEN 'valid'
                   ELSE 'train' END AS split
  FROM pairs_v p WHERE pair_id NOT IN (SELECT pair_id FROM gold_v))"""


# ============================================================================ 4. assembly

def _training_set(spark, sf):
    parts = _parts(spark, sf)
    pos = TS.positives(parts, CFG)
    neg = TS.negatives(parts, CFG).drop("other_cluster_id")
    return parts, pos, neg, pos.unionByName(neg)


_ASM = _NEG + O.positives_ctes(CFG.positives) + [
    "tset AS (SELECT cluster_id, id_left, id_right, 1 AS label FROM psample UNION ALL"
    " SELECT cluster_id, id_left, id_right, 0 AS label FROM nsample)"]


@register("training_set", O.with_fixtures(*_ASM) +
          "\nSELECT cluster_id, id_left, id_right, label FROM tset")
def training_set(spark, sf):
    return _training_set(spark, sf)[3]


@register("gold_leak_count", O.with_fixtures(*_ASM) + """
SELECT count(*) AS leaks FROM gnorm g
WHERE EXISTS (SELECT 1 FROM tset t WHERE least(t.id_left, t.id_right) = g.id_left
              AND greatest(t.id_left, t.id_right) = g.id_right)""")
def gold_leak_count(spark, sf):
    parts, _, _, ts = _training_set(spark, sf)
    key = ts.select(F.least("id_left", "id_right").alias("id_left"),
                    F.greatest("id_left", "id_right").alias("id_right")).distinct()
    return parts.gold_norm.join(key, ["id_left", "id_right"], "left_semi") \
        .agg(F.count(F.lit(1)).alias("leaks"))


@register("training_set_stats", O.with_fixtures(*_ASM) + """
SELECT split_part(cluster_id, '/', 1) AS category,
       CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives,
       CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS negatives,
       count(*) AS combined
FROM tset GROUP BY 1""")
def training_set_stats(spark, sf):
    ts = _training_set(spark, sf)[3]
    return ts.groupBy(F.split("cluster_id", "/").getItem(0).alias("category")).agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).cast("long").alias("positives"),
        F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).cast("long").alias("negatives"),
        F.count(F.lit(1)).alias("combined"))


@register("same_title_negatives", O.with_fixtures(*_ASM) + """
SELECT split_part(n.cluster_id, '/', 1) AS category, count(*) AS same_title
FROM nsample n JOIN clean a ON a.id = n.id_left JOIN clean b ON b.id = n.id_right
WHERE a.title = b.title GROUP BY 1""")
def same_title_negatives(spark, sf):
    parts, _, neg, _ = _training_set(spark, sf)
    t = TS.attach_titles(neg, parts.clean)
    return (t.where(F.col("title_left") == F.col("title_right"))
            .groupBy(F.split("cluster_id", "/").getItem(0).alias("category"))
            .agg(F.count(F.lit(1)).alias("same_title")))


@register("sampling_diagnostics", O.with_fixtures(*_ASM) + """,
pos_n AS (SELECT cluster_id, count(*) AS n, bool_and(bad) AS all_bad, max(S) AS S
          FROM (SELECT s.cluster_id, p.bad, q.S FROM psample s JOIN pcand p
                USING (cluster_id, id_left, id_right) JOIN pplan2 q USING (cluster_id)) x
          GROUP BY ALL),
neg_own AS (SELECT DISTINCT owner FROM owned2),
neg_n AS (SELECT owner, count(*) AS n, bool_and(bad) AS all_bad, max(S) AS S FROM (
          SELECT s.cluster_id AS owner, u.bad, u.S FROM nsample s JOIN nu2 u
          ON u.owner = s.cluster_id AND u.id_left = s.id_left AND u.id_right = s.id_right) x
          GROUP BY ALL)
SELECT (SELECT count(*) FROM psample) AS positive_pairs,
       (SELECT count(*) FROM nsample) AS negative_pairs,
       (SELECT count(*) FROM pos_n WHERE S = 1 AND all_bad) AS pos_clusters_no_clean_pair,
       (SELECT count(*) FROM gclusters WHERE cluster_id NOT IN (SELECT cluster_id FROM pos_n))
         AS pos_clusters_no_pair,
       (SELECT count(*) FROM gclusters WHERE cluster_id NOT IN (SELECT owner FROM neg_own))
         AS neg_clusters_all_seen,
       (SELECT count(*) FROM neg_n WHERE S = 1 AND all_bad) AS neg_owners_no_clean_pair,
       (SELECT count(*) FROM neg_own WHERE owner NOT IN (SELECT owner FROM neg_n))
         AS neg_owners_no_pair""")
def sampling_diagnostics(spark, sf):
    """Counts the sampling reports: clusters without a clean pair, without any pair, clusters
    whose similar pairs were all owned by earlier clusters, and pair totals."""
    parts = _parts(spark, sf)
    pos = TS.positive_sample(parts, CFG)
    plan = TS.positive_plan(parts.ranked, parts.gold_norm, CFG.positives)
    pos_n = pos.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"),
                                          F.min(F.col("bad").cast("int")).alias("all_bad"))
    pos_n = pos_n.join(plan.select("cluster_id", "S"), "cluster_id")
    owned = TS.owned_pairs(parts, CFG)
    neg = TS.negative_sample(parts, CFG)
    nplan = TS.negative_plan(parts.ranked, parts.gold_norm, owned, CFG.negatives, CFG.seed) \
        .groupBy("owner").agg(F.max("S").alias("S"))
    neg_n = neg.groupBy("owner").agg(F.count(F.lit(1)).alias("n"),
                                     F.min(F.col("bad").cast("int")).alias("all_bad")) \
        .join(nplan, "owner")
    owners = owned.select("owner").distinct()
    c = parts.clusters
    row = [
        pos.agg(F.count(F.lit(1)).alias("positive_pairs")),
        neg.agg(F.count(F.lit(1)).alias("negative_pairs")),
        pos_n.where((F.col("S") == 1) & (F.col("all_bad") == 1))
        .agg(F.count(F.lit(1)).alias("pos_clusters_no_clean_pair")),
        c.join(pos_n, "cluster_id", "left_anti").agg(F.count(F.lit(1)).alias("pos_clusters_no_pair")),
        c.join(owners.withColumnRenamed("owner", "cluster_id"), "cluster_id", "left_anti")
        .agg(F.count(F.lit(1)).alias("neg_clusters_all_seen")),
        neg_n.where((F.col("S") == 1) & (F.col("all_bad") == 1))
        .agg(F.count(F.lit(1)).alias("neg_owners_no_clean_pair")),
        owners.join(neg_n, "owner", "left_anti").agg(F.count(F.lit(1)).alias("neg_owners_no_pair")),
    ]
    out = row[0]
    for r in row[1:]:
        out = _one_row_join(out, r)
    return out


def _one_row_join(a, b):
    """Side by side of two single-row aggregates (equi-join on a constant key)."""
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")


# ============================================================================ 5. noise, splits

@register("label_noise", O.with_fixtures("""
ranked_l AS (SELECT pair_id, label, row_number() OVER (PARTITION BY label ORDER BY
   """ + O.seeded(CFG.seed, "pair_id") + """, pair_id) - 1 AS cpos,
   count(*) OVER (PARTITION BY label) AS n FROM pairs_v)""") + """
SELECT pair_id, CASE WHEN cpos < floor(CAST(n AS DOUBLE) * CAST(0.1 AS DOUBLE))
                THEN 1 - label ELSE label END AS label,
       cpos < floor(CAST(n AS DOUBLE) * CAST(0.1 AS DOUBLE)) AS flipped
FROM ranked_l""")
def label_noise(spark, sf):
    p = FX.pair_labels(spark, sf).select("pair_id", "label")
    return SP.add_label_noise(p, "pair_id", "label", 0.1, 0.1, 1, 1, CFG.seed)


_GRID_VALUES = ", ".join(f"('{SP.noise_setting_name(r, s)}', CAST({r} AS DOUBLE), {s})"
                         for r, s in SP.NOISE_GRID)


@register("label_noise_grid", O.with_fixtures(f"""
grid(setting, rate, steps) AS (VALUES {_GRID_VALUES})""", """
ranked_l AS (SELECT pair_id, label, row_number() OVER (PARTITION BY label ORDER BY
   """ + O.seeded(CFG.seed, "pair_id") + """, pair_id) - 1 AS cpos,
   count(*) OVER (PARTITION BY label) AS n FROM pairs_v)""") + """
SELECT g.setting, r.pair_id,
       CASE WHEN r.cpos < g.steps * floor(CAST(r.n AS DOUBLE) * g.rate) THEN 1 - r.label
            ELSE r.label END AS label,
       r.cpos < g.steps * floor(CAST(r.n AS DOUBLE) * g.rate) AS flipped
FROM ranked_l r, grid g""")
def label_noise_grid(spark, sf):
    p = FX.pair_labels(spark, sf).select("pair_id", "label")
    return SP.label_noise_grid(p, "pair_id", "label", SP.NOISE_GRID, CFG.seed)


@register("split_train", O.with_fixtures() + """
SELECT pair_id, label FROM pairs_v
WHERE pair_id NOT IN (SELECT pair_id FROM valid_ids_v)""")
def split_train(spark, sf):
    tr, _ = SP.split_by_ids(FX.pair_labels(spark, sf).select("pair_id", "label"),
                            FX.valid_ids(spark, sf))
    return tr


@register("split_valid", O.with_fixtures() + """
SELECT pair_id, label FROM pairs_v WHERE pair_id IN (SELECT pair_id FROM valid_ids_v)""")
def split_valid(spark, sf):
    _, va = SP.split_by_ids(FX.pair_labels(spark, sf).select("pair_id", "label"),
                            FX.valid_ids(spark, sf))
    return va


@register("seeded_order", O.with_fixtures() + """
SELECT pair_id, row_number() OVER (ORDER BY """ + O.seeded(CFG.seed, "pair_id") + """, pair_id) - 1 AS position FROM pairs_v""")
def seeded_order(spark, sf):
    """Each pair's place in the seeded shuffle."""
    return SP.seeded_positions(FX.pair_labels(spark, sf).select("pair_id"), "pair_id", CFG.seed)


@register("stratified_folds", O.with_fixtures(_SPLITS_CTE) + """
SELECT split, pair_id, label, ntile(5) OVER (PARTITION BY label ORDER BY
       CASE split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END, pair_id) - 1 AS fold
FROM splits_v""")
def stratified_folds(spark, sf):
    s = FX.split_rows(spark, sf).select("split", "pair_id", "label")
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "valid", 1).otherwise(2)
    f = SP.stratified_folds(s, "label", [order, "pair_id"], 5)
    return f.withColumn("fold", F.col("fold").cast("long"))


@register("label_distribution", O.with_fixtures() +
          "\nSELECT label, count(*) AS n FROM pairs_v GROUP BY label")
def label_distribution(spark, sf):
    return M.label_distribution(FX.pair_labels(spark, sf).select("label"))


@register("class_ratio", O.with_fixtures() + """
SELECT positives, negatives, CAST(round_even(negatives / positives, 0) AS BIGINT) AS ratio
FROM (SELECT CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives,
             CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS negatives
      FROM pairs_v) t""")
def class_ratio(spark, sf):
    return M.class_ratio(FX.pair_labels(spark, sf).select("label"))


@register("null_profile", """
SELECT 'conv_id' AS "column", CAST(count(*) - count(conv_id) AS BIGINT) AS nulls FROM conversations
UNION ALL SELECT 'turn', CAST(count(*) - count(turn) AS BIGINT) FROM conversations
UNION ALL SELECT 'role', CAST(count(*) - count(role) AS BIGINT) FROM conversations
UNION ALL SELECT 'text', CAST(count(*) - count(text) AS BIGINT) FROM conversations""")
def null_profile(spark, sf):
    return M.null_profile(read_table(spark, sf, "conversations"))


# ============================================================================ 6. reshaping

@register("entity_tables", O.with_fixtures("""
sides AS (SELECT id_left AS id, 0 AS side, pair_id, title_left AS title,
                 description_left AS description, brand_left AS brand FROM pairs_v
          UNION ALL
          SELECT id_right, 1, pair_id, title_right, description_right, brand_right FROM pairs_v)
""") + """
SELECT id, title, description, brand FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY side, pair_id) AS rn FROM sides) t
WHERE rn = 1""")
def entity_tables(spark, sf):
    return SH.entity_table(FX.pair_rows(spark, sf), ["title", "description", "brand"], rows=FX.offer_rows(spark, sf))


@register("surrogate_keys", O.with_fixtures("""
ents AS (SELECT DISTINCT id FROM (SELECT id_left AS id FROM pairs_v UNION ALL
                                  SELECT id_right FROM pairs_v) t)""", """
ek AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS mag_id FROM ents)""") + """
SELECT p.pair_id, p.id_left, p.id_right, p.label,
       row_number() OVER (ORDER BY p.pair_id) - 1 AS _id,
       l.mag_id AS ltable_mag_id, r.mag_id AS rtable_mag_id
FROM pairs_v p LEFT JOIN ek l ON l.id = p.id_left LEFT JOIN ek r ON r.id = p.id_right""")
def surrogate_keys(spark, sf):
    p = FX.pair_rows(spark, sf)
    ents = SH.entity_table(p, ["title"])
    out = SH.attach_surrogate_keys(p, ents)
    return out.select("pair_id", "id_left", "id_right", "label", "_id", "ltable_mag_id",
                      "rtable_mag_id")


@register("key_violations", O.with_fixtures() + """
SELECT id, count(*) AS n FROM (SELECT id_left AS id FROM pairs_v UNION ALL
                               SELECT id_right FROM pairs_v) t
GROUP BY id HAVING id IS NULL OR count(*) > 1""")
def key_violations_q(spark, sf):
    p = FX.pair_rows(spark, sf)
    sides = p.select(F.col("id_left").alias("id")).unionAll(p.select(F.col("id_right").alias("id")))
    return key_violations(sides, "id")


@register("fk_violations", """
SELECT 'lineitem.l_partkey' AS fk, count(*) AS violations FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'lineitem.l_suppkey', count(*) FROM lineitem
WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'lineitem.l_orderkey', count(*) FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'orders.o_custkey', count(*) FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def fk_violations_q(spark, sf):
    li = read_table(spark, sf, "lineitem")
    o = read_table(spark, sf, "orders")
    checks = [
        ("lineitem.l_partkey", li, "l_partkey", read_table(spark, sf, "part"), "p_partkey"),
        ("lineitem.l_suppkey", li, "l_suppkey", read_table(spark, sf, "supplier"), "s_suppkey"),
        ("lineitem.l_orderkey", li, "l_orderkey", o, "o_orderkey"),
        ("orders.o_custkey", o, "o_custkey", read_table(spark, sf, "customer"), "c_custkey"),
    ]
    out = None
    for name, df, fk, ref, rk in checks:
        v = fk_violations(df.select(fk), fk, ref, rk).agg(F.count(F.lit(1)).alias("violations")) \
            .select(F.lit(name).alias("fk"), "violations")
        out = v if out is None else out.unionByName(v)
    return out


_ALNUM = "trim(regexp_replace(coalesce(CAST({c} AS VARCHAR), ''), '[^0-9a-zA-Z]+', ' ', 'g'))"


@register("flatten_for_matcher", O.with_fixtures(_SPLITS_CTE) + "\nSELECT split, pair_id AS id, label, "
          + ", ".join(f"{_ALNUM.format(c=f'{a}_{s}')} AS {s}_{a}"
                      for a in ("title", "description", "brand") for s in ("left", "right"))
          + " FROM splits_v")
def flatten_for_matcher(spark, sf):
    return SH.flatten_for_matcher(FX.splits(spark, sf), "pair_id", "label", carry=["split"])


def _tables(spark, sf):
    part = read_table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type",
                                                "p_size")
    supp = read_table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    li = read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_linestatus") == "O").cast("int").alias("label"))
    return part, supp, li


@register("pairs_from_tables", """
SELECT row_number() OVER (ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey) AS id,
       CAST(l.l_linestatus = 'O' AS INTEGER) AS label,
       p.p_partkey AS left_p_partkey, p.p_name AS left_p_name, p.p_brand AS left_p_brand,
       p.p_type AS left_p_type, p.p_size AS left_p_size,
       s.s_suppkey AS right_s_suppkey, s.s_name AS right_s_name,
       s.s_nationkey AS right_s_nationkey
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
JOIN supplier s ON s.s_suppkey = l.l_suppkey""")
def pairs_from_tables(spark, sf):
    part, supp, li = _tables(spark, sf)
    return SH.pairs_from_tables(part, supp, li, "p_partkey", "s_suppkey", "l_partkey",
                                "l_suppkey", "label", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@register("keep_name_only", """
SELECT row_number() OVER (ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey) AS id,
       CAST(l.l_linestatus = 'O' AS INTEGER) AS label,
       p.p_name AS left_Name, s.s_name AS right_Name
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
JOIN supplier s ON s.s_suppkey = l.l_suppkey""")
def keep_name_only(spark, sf):
    return SH.keep_name_only(pairs_from_tables(spark, sf))


@register("positional_join", """
SELECT a.line_no, a.name, b.words FROM
  (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS line_no, p_name AS name FROM part) a
JOIN
  (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS line_no, p_type AS words FROM part) b
USING (line_no)""")
def positional_join(spark, sf):
    part = read_table(spark, sf, "part")
    a = part.select("p_partkey", F.col("p_name").alias("name"))
    b = part.select(F.col("p_partkey").alias("k"), F.col("p_type").alias("words"))
    return SH.line_aligned_join(a, b, ["p_partkey"], ["k"]).select("line_no", "name", "words")


@register("name_lookup", """
WITH names AS (SELECT p_name AS name, arg_max(p_type, p_partkey) AS w FROM part GROUP BY p_name),
clean AS (SELECT name, CASE WHEN starts_with(w, 'null') AND ends_with(w, 'null') THEN ''
                            ELSE w END AS w FROM names)
SELECT l.l_orderkey, l.l_linenumber, a.p_name AS left_name, ca.w AS left_name_words,
       b.p_name AS right_name, cb.w AS right_name_words
FROM lineitem l JOIN part a ON a.p_partkey = l.l_partkey
JOIN part b ON b.p_partkey = l.l_suppkey
LEFT JOIN clean ca ON ca.name = a.p_name LEFT JOIN clean cb ON cb.name = b.p_name""")
def name_lookup(spark, sf):
    part = read_table(spark, sf, "part")
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                                  "l_suppkey")
    a = part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("left_name"))
    b = part.select(F.col("p_partkey").alias("l_suppkey"), F.col("p_name").alias("right_name"))
    pairs = li.join(a, "l_partkey").join(b, "l_suppkey")
    names = part.select(F.col("p_name").alias("name"), F.col("p_type").alias("words"),
                        F.col("p_partkey").alias("line_no"))
    out = SH.name_lookup(pairs, names, "left_name", "right_name")
    return out.select("l_orderkey", "l_linenumber", "left_name", "left_name_words",
                      "right_name", "right_name_words")


@register("all_names", O.with_fixtures(_SPLITS_CTE) + """
SELECT split, pair_id, 0 AS side, title_left AS name FROM splits_v
UNION ALL SELECT split, pair_id, 1, title_right FROM splits_v""")
def all_names(spark, sf):
    s = FX.split_rows(spark, sf).select("split", "pair_id", "title_left", "title_right")
    return SH.all_names(s, "title_left", "title_right").select(
        "split", "pair_id", F.col("side").cast("int").alias("side"), "name")


@register("all_names_normalized", O.with_fixtures(_SPLITS_CTE) + """
SELECT split, pair_id, side, CASE WHEN length(n) = 0 THEN 'NONE' ELSE n END AS name FROM (
  SELECT split, pair_id, side, """ + _NAME_SQL + """ AS n FROM (
    SELECT split, pair_id, 0 AS side, title_left AS name FROM splits_v
    UNION ALL SELECT split, pair_id, 1, title_right FROM splits_v) a) b""")
def all_names_normalized(spark, sf):
    n = all_names(spark, sf)
    return n.withColumn("name", T.normalize_name(F.col("name")))


def _sentences(spark, sf):
    p = FX.pairs(spark, sf)
    left = [F.col(f"{a}_left") for a in ("title", "description", "brand")]
    right = [F.col(f"{a}_right") for a in ("title", "description", "brand")]
    return p.select("pair_id", F.col("label").alias("similarity"),
                    F.concat_ws(" ", *left).alias("sentence1"),
                    F.concat_ws(" ", *right).alias("sentence2"))


@register("sentence_pairs", O.with_fixtures() + """
SELECT pair_id, label AS similarity,
       concat_ws(' ', title_left, description_left, brand_left) AS sentence1,
       concat_ws(' ', title_right, description_right, brand_right) AS sentence2
FROM pairs_v""")
def sentence_pairs(spark, sf):
    return _sentences(spark, sf)


@register("sentence_stats", """
SELECT role, max(n) AS longest, min(n) AS shortest, round(avg(n), 6) AS mean_words FROM (
  SELECT role, len(""" + O.split_ws_sql("text") + """) AS n FROM conversations) t
GROUP BY role""")
def sentence_stats(spark, sf):
    s = M.sentence_stats(read_table(spark, sf, "conversations"), "text", ["role"])
    return s.select("role", F.col("longest").cast("long").alias("longest"),
                    F.col("shortest").cast("long").alias("shortest"),
                    F.round("mean_words", 6).alias("mean_words"))


@register("label_index", """
WITH roles AS (SELECT role, row_number() OVER (ORDER BY role) - 1 AS idx,
                      count(*) OVER () AS k FROM (SELECT DISTINCT role FROM conversations) r)
SELECT c.conv_id, c.turn, c.role, r.idx AS label_idx,
       array_to_string(list_transform(range(r.k), lambda i: CASE WHEN i = r.idx THEN '1'
                                                                ELSE '0' END), ',') AS one_hot
FROM conversations c JOIN roles r USING (role)""")
def label_index(spark, sf):
    from matchsmith.functions.labels import index_labels
    c = read_table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return index_labels(c, "role", "label_idx", "one_hot")


@register("vector_argmax", """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS argmax
FROM embeddings""")
def vector_argmax(spark, sf):
    from matchsmith.functions.labels import argmax
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", argmax(F.col("embedding")).alias("argmax"))


@register("prediction_flags", """
SELECT doc_id, quality AS truth, toxic AS pred,
       CASE WHEN toxic = quality THEN 'ok' ELSE 'wrong' END AS result FROM labels""")
def prediction_flags(spark, sf):
    lab = read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("truth"),
                                                 F.col("toxic").alias("pred"))
    return M.prediction_flags(lab, "truth", "pred")


_PCM_SQL = """
WITH b AS (SELECT quality AS t, toxic AS p FROM labels),
cls AS (SELECT t AS cls FROM b UNION SELECT p FROM b),
m AS (SELECT c.cls,
        (SELECT count(*) FROM b WHERE t = c.cls AND p = c.cls) AS tp,
        (SELECT count(*) FROM b WHERE t = c.cls) AS support,
        (SELECT count(*) FROM b WHERE p = c.cls) AS predicted FROM cls c),
pr AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
              CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM m),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
                     ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr)"""


@register("per_class_metrics", _PCM_SQL + """
SELECT cls AS class, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, support, tp, predicted FROM f""")
def per_class_metrics(spark, sf):
    lab = read_table(spark, sf, "labels")
    m = M.per_class_metrics(lab, "quality", "toxic")
    return m.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                    "support", "tp", "predicted")


@register("averaged_metrics", _PCM_SQL + """
SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall,
       round(avg(f1), 6) AS macro_f1,
       round(sum(precision * support) / sum(support), 6) AS weighted_precision,
       round(sum(recall * support) / sum(support), 6) AS weighted_recall,
       round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
       round(sum(tp) / sum(support), 6) AS accuracy, round(sum(tp) / sum(support), 6) AS micro_f1
FROM f""")
def averaged_metrics(spark, sf):
    lab = read_table(spark, sf, "labels")
    a = M.averaged_metrics(M.per_class_metrics(lab, "quality", "toxic"))
    return a.select(*[F.round(c, 6).alias(c) for c in a.columns])


@register("fold_average", """
WITH f AS (SELECT doc_id, quality AS t, toxic AS p,
                  ntile(5) OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS fold FROM labels),
m AS (SELECT fold,
        count(*) FILTER (WHERE t = 1 AND p = 1) AS tp,
        count(*) FILTER (WHERE p = 1) AS predicted,
        count(*) FILTER (WHERE t = 1) AS support FROM f GROUP BY fold),
pr AS (SELECT fold, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
              CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM m),
x AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
                     ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr)
SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
       round(avg(f1), 6) AS f1, count(*) AS folds FROM x""")
def fold_average(spark, sf):
    lab = read_table(spark, sf, "labels")
    f = SP.stratified_folds(lab, "quality", ["doc_id"], 5)
    pc = M.per_class_metrics(f, "quality", "toxic", ["fold"])
    c1 = pc.where(F.col("class") == 1)
    a = c1.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
               F.avg("f1").alias("f1"), F.count(F.lit(1)).alias("folds"))
    return a.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "folds")



def _grid_sql() -> str:
    subs = []
    for label in TS.TRAINING_SET_SETTINGS:
        cfg = TS.parse_setting(label, CFG)
        ctes = (O.training_ctes(cfg.seed, cfg.min_words) + O.similarity_ctes()
                + O.negatives_ctes(cfg.negatives, cfg.similar_clusters, cfg.seed)
                + O.positives_ctes(cfg.positives))
        subs.append(f"SELECT '{label}' AS setting, * FROM (" + O.with_fixtures(*ctes) +
                    "\nSELECT cluster_id, id_left, id_right, 1 AS label FROM psample UNION ALL"
                    " SELECT cluster_id, id_left, id_right, 0 AS label FROM nsample) s" + str(len(subs)))
    return "\nUNION ALL\n".join(subs)


@register("training_set_grid", _grid_sql())
def training_set_grid(spark, sf):
    """The four training-set settings (1-3, 3-9, 15-45, 50-150 pairs per cluster)."""
    g = TS.training_set_grid(FX.offers(spark, sf), FX.gold(spark, sf))
    return g.select("setting", "cluster_id", "id_left", "id_right", "label")
