"""Registered queries for vectors, pair features and matchers."""

from __future__ import annotations

import time

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from matchsmith.functions import align as AL
from matchsmith.operators import shape as SH
from matchsmith.operators import vectors as V
from matchsmith.plans import experiments as EX
from matchsmith.plans import features as FE
from matchsmith.plans import model_tables as MT
from matchsmith.plans import models as MD
from matchsmith.plans import oracle as O
from matchsmith.plans.catalog import register
from matchsmith.plans.catalog_more import _SPLITS_CTE
from matchsmith.session import materialize, read_table, scratch_path, session_memo
from matchsmith.sources import fixtures as FX

COMBOS = {"t": ["title"], "td": ["title", "description"],
          "tdb": ["title", "description", "brand"]}
ATTRS = ["title", "description", "brand"]


def _entity_pairs(spark, sf, train_only: bool):
    s = FX.split_rows(spark, sf)
    return s.where(F.col("split") != "test") if train_only else s


def _entities(spark, sf, train_only: bool):
    return SH.entity_table(_entity_pairs(spark, sf, train_only), ATTRS, rows=FX.offer_rows(spark, sf))


def _types(spark, sf):
    return FE.attribute_types(SH.entity_rows(_entity_pairs(spark, sf, True)), ATTRS, FX.offer_rows(spark, sf))


def _vocab(spark, sf):
    return session_memo(spark, ("vocab", sf), lambda: materialize(
        V.vocabulary(_entities(spark, sf, True), COMBOS, 2)))


def _vectors(spark, sf):
    """Word vectors of every entity (train vocabulary), built once per application."""
    vocab = _vocab(spark, sf)
    vec = session_memo(spark, ("vectors", sf), lambda: materialize(
        V.word_vectors(_entities(spark, sf, False), COMBOS, vocab)))
    return vec, vocab


def _combo_sql(alias: str) -> str:
    parts = []
    for name, cols in COMBOS.items():
        txt = "trim(concat_ws(' ', " + ", ".join(f"coalesce({c}, '')" for c in cols) + "))"
        parts.append(f"SELECT '{name}' AS combo, id, {txt} AS text FROM {alias}")
    return " UNION ALL ".join(parts)


_VEC_CTES = [
    _SPLITS_CTE,
    "ents_all AS (SELECT DISTINCT id, title, description, brand FROM ("
    " SELECT id_left AS id, title_left AS title, description_left AS description,"
    " brand_left AS brand, split FROM splits_v UNION ALL"
    " SELECT id_right, title_right, description_right, brand_right, split FROM splits_v) t)",
    "ents_train AS (SELECT DISTINCT id, title, description, brand FROM ("
    " SELECT id_left AS id, title_left AS title, description_left AS description,"
    " brand_left AS brand FROM splits_v WHERE split <> 'test' UNION ALL"
    " SELECT id_right, title_right, description_right, brand_right FROM splits_v"
    " WHERE split <> 'test') t)",
    f"texts_train AS ({_combo_sql('ents_train')})",
    f"texts_all AS ({_combo_sql('ents_all')})",
    f"words_train AS (SELECT DISTINCT combo, id, unnest({O.vocab_sql('text')}) AS word"
    " FROM texts_train)",
    "vocab AS (SELECT combo, word, count(*) AS df,"
    " row_number() OVER (PARTITION BY combo ORDER BY word) - 1 AS idx"
    " FROM words_train GROUP BY combo, word HAVING count(*) >= 2)",
    f"words_all AS (SELECT DISTINCT combo, id, unnest({O.vocab_sql('text')}) AS word"
    " FROM texts_all)",
    "vec AS (SELECT t.combo, t.id, coalesce(v.idx, []) AS idx FROM texts_all t LEFT JOIN"
    " (SELECT w.combo, w.id, list_sort(list(v.idx)) AS idx FROM words_all w JOIN vocab v"
    " USING (combo, word) GROUP BY ALL) v USING (combo, id))",
]


@register("vocabulary", O.with_fixtures(*_VEC_CTES) + "\nSELECT combo, word, df, idx FROM vocab")
def vocabulary(spark, sf):
    return _vocab(spark, sf).select("combo", "word", "df", "idx")


@register("word_occurrence", O.with_fixtures(*_VEC_CTES) + """
SELECT combo, id, len(idx) AS n_words, array_to_string(idx, ',') AS idx FROM vec""")
def word_occurrence(spark, sf):
    vec, _ = _vectors(spark, sf)
    return vec.select("combo", "id", F.size("idx").cast("long").alias("n_words"),
                      F.array_join("idx", ",").alias("idx"))


@register("word_cooccurrence", O.with_fixtures(*_VEC_CTES) + """
SELECT s.split, s.pair_id, l.combo,
       len(list_sort(list_intersect(l.idx, r.idx))) AS n_shared,
       array_to_string(list_sort(list_intersect(l.idx, r.idx)), ',') AS shared
FROM splits_v s JOIN vec l ON l.id = s.id_left JOIN vec r ON r.id = s.id_right
 AND r.combo = l.combo""")
def word_cooccurrence(spark, sf):
    vec, _ = _vectors(spark, sf)
    pairs = FX.split_rows(spark, sf).select("split", "pair_id", "id_left", "id_right")
    c = V.cooccurrence(pairs, vec)
    return c.select("split", "pair_id", "combo", F.size("shared").cast("long").alias("n_shared"),
                    F.array_join("shared", ",").alias("shared"))


def _types_sql(src: str) -> str:
    rows = []
    for a in ATTRS:
        wc = "len(" + O.split_ws_sql(f"CAST({a} AS VARCHAR)") + ")"
        rows.append(f"SELECT '{a}' AS attribute, avg(CASE WHEN {a} IS NOT NULL AND {a} <> ''"
                    f" THEN {wc} END) AS avg_words FROM {src}")
    body = " UNION ALL ".join(rows)
    typ = "CASE WHEN avg_words = 1 THEN 'str_eq_1w' WHEN avg_words <= 5 THEN 'str_bt_1w_5w'" \
          " WHEN avg_words <= 10 THEN 'str_bt_5w_10w' ELSE 'str_gt_10w' END"
    return f"SELECT attribute, round(avg_words, 6) AS avg_words, {typ} AS type FROM ({body}) t"


@register("attribute_types", O.with_fixtures(*_VEC_CTES) + "\n" + _types_sql("ents_train"))
def attribute_types(spark, sf):
    t = _types(spark, sf)
    return t.select("attribute", F.round("avg_words", 6).alias("avg_words"), "type")


def _plan(spark, sf, include_align=True):
    t = _types(spark, sf)
    types = {r["attribute"]: r["type"] for r in t.collect()}  # one row per attribute
    return FE.feature_plan({a: types[a] for a in ATTRS}, include_align)


def _features(spark, sf, include_align=True):
    plan = _plan(spark, sf, include_align)
    # set measures only ask whether a pair's description is there; others read it
    whole = any(a == "description" and m not in FE._SET_TOKENS for a, m in plan)
    pairs = FX.splits(spark, sf) if whole else FX.split_rows(spark, sf)
    ents = SH.entity_rows(_entity_pairs(spark, sf, False))
    return FE.pair_features(pairs, plan, ["split", "pair_id", "label"], entities=ents, rows=FX.offer_rows(spark, sf)), plan


# Measures in SQL for the oracle (same definitions as features.measure).
def _measure_sql(m: str, a: str, b: str) -> str:
    if m == "lev_dist":
        v = f"CAST(levenshtein({a}, {b}) AS DOUBLE)"
    elif m == "lev_sim":
        v = f"1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))"
    elif m == "exact_match":
        v = f"CAST({a} = {b} AS DOUBLE)"
    elif m == "jaro":
        v = f"jaro_similarity({a}, {b})"
    elif m == "jaro_winkler":
        v = f"jaro_winkler_similarity({a}, {b})"
    else:
        raise ValueError(m)
    return (f"CASE WHEN {a} IS NULL OR {b} IS NULL OR {a} = '' OR {b} = '' THEN NULL"
            f" ELSE {v} END")


def _features_sql() -> list[str]:
    """CTEs up to ``feat_v``: the planned measures of every pair. Token sets once an entity, as
    rows; what two entities share by a join and a count."""
    ctes, joins, cols = [], [], []
    for a, m in _SQL_PLAN:
        x, y = f"s.{a}_left", f"s.{a}_right"
        if m not in FE._SET_TOKENS:
            cols.append(f"{_measure_sql(m, x, y)} AS {a}_{m}")
            continue
        k = FE._SET_TOKENS[m]
        name = f"{a}_{k}"
        if not any(c.startswith(f"{name} AS") for c in ctes):
            if k == "qg3":
                tok = (f"SELECT DISTINCT id, c || c2 || c3 AS tok FROM (SELECT id, c, lead(c) OVER w AS c2, lead(c, 2) OVER w AS c3 FROM"
                       f" (SELECT id, unnest(string_split('##' || {a} || '$$', '')) AS c, generate_subscripts(string_split('##' || {a} || '$$', ''), 1) AS i"
                       f" FROM ents_all WHERE {a} <> '') WINDOW w AS (PARTITION BY id ORDER BY i)) WHERE c3 IS NOT NULL")
            else:
                tok = f"SELECT DISTINCT id, unnest({O.split_ws_sql(a)}) AS tok FROM ents_all"
            ctes += [f"{name} AS MATERIALIZED ({tok})", f"{name}_n AS (SELECT id, count(*) AS n FROM {name} GROUP BY id)",
                     f"{name}_i AS (SELECT p.pair_id, count(*) AS n FROM splits_v p JOIN {name} l ON l.id = p.id_left"
                     f" JOIN {name} r ON r.id = p.id_right AND r.tok = l.tok GROUP BY p.pair_id)"]
            joins.append(f"LEFT JOIN {name}_n {name}_l ON {name}_l.id = s.id_left LEFT JOIN {name}_n {name}_r ON {name}_r.id = s.id_right"
                         f" LEFT JOIN {name}_i ON {name}_i.pair_id = s.pair_id")
        i, n, o = f"coalesce({name}_i.n, 0)", f"coalesce({name}_l.n, 0)", f"coalesce({name}_r.n, 0)"
        v = f"{i} / nullif(sqrt({n} * {o}), 0)" if m == "cosine_dlm" else f"{i} / nullif({n} + {o} - {i}, 0)"
        cols.append(f"CASE WHEN {x} IS NULL OR {y} IS NULL OR {x} = '' OR {y} = '' THEN NULL ELSE {v} END AS {a}_{m}")
    return [*ctes, f"feat_v AS MATERIALIZED (SELECT s.split, s.pair_id, s.label, {', '.join(cols)} FROM splits_v s {' '.join(joins)})"]


# Plan the sf0.01 attribute types give (pinned by the attribute_types query above).
_SQL_TYPES = {"title": "str_gt_10w", "description": "str_gt_10w", "brand": "str_eq_1w"}
_SQL_PLAN = FE.feature_plan(_SQL_TYPES)


_FEAT_CTES = [*_VEC_CTES[:2], *_features_sql()]
_FEAT_NAMES = [f"{a}_{m}" for a, m in _SQL_PLAN]


@register("pair_features", O.with_fixtures(*_FEAT_CTES) + "\nSELECT split, pair_id, label, "
          + ", ".join(f"round({c}, 6) AS {c}" for c in _FEAT_NAMES) + " FROM feat_v")
def pair_features(spark, sf):
    f, plan = _features(spark, sf)
    return f.select("split", "pair_id", "label",
                    *[F.round(f"{a}_{m}", 6).alias(f"{a}_{m}") for a, m in plan])


@register("pair_features_align")
def pair_features_align(spark, sf):
    """Alignment measures through Arrow-batched pandas UDFs (no SQL twin for the last three)."""
    p = FX.pair_rows(spark, sf)
    a, b = F.col("title_left"), F.col("title_right")
    return p.select(
        "pair_id",
        F.round(AL.jaro_udf(F.col("brand_left"), F.col("brand_right")), 6).alias("brand_jaro"),
        F.round(AL.jaro_winkler_udf(F.col("brand_left"), F.col("brand_right")), 6)
        .alias("brand_jaro_winkler"),
        F.round(AL.monge_elkan_udf(a, b), 6).alias("title_monge_elkan"),
        F.round(AL.needleman_wunsch_udf(a, b), 6).alias("title_needleman_wunsch"),
        F.round(AL.smith_waterman_udf(a, b), 6).alias("title_smith_waterman"))


@register("pair_features_jaro", O.with_fixtures() + r"""
SELECT pair_id, round(jaro_similarity(a, b), 6) AS title_jaro,
       round(jaro_winkler_similarity(a, b), 6) AS title_jaro_winkler
FROM (SELECT pair_id,
             trim(regexp_replace(coalesce(title_left, ''), '[^0-9a-zA-Z]+', ' ', 'g')) AS a,
             trim(regexp_replace(coalesce(title_right, ''), '[^0-9a-zA-Z]+', ' ', 'g')) AS b
      FROM pairs_v) t""")
def pair_features_jaro(spark, sf):
    """Jaro and Jaro-Winkler of the alphanumeric-only titles (the matcher input form)."""
    from matchsmith.functions.text import alnum_only
    p = FX.pair_rows(spark, sf)
    a, b = alnum_only(F.col("title_left")), alnum_only(F.col("title_right"))
    return p.select("pair_id", F.round(AL.jaro_udf(a, b), 6).alias("title_jaro"),
                    F.round(AL.jaro_winkler_udf(a, b), 6).alias("title_jaro_winkler"))


@register("vector_abs_diff", """
SELECT a.vec_id, b.vec_id AS other_id, CAST(a.label = b.label AS INTEGER) AS same,
       round(list_sum(list_transform(range(1, len(a.embedding) + 1),
             lambda i: abs(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)))), 6)
         AS l1,
       round(list_max(list_transform(range(1, len(a.embedding) + 1),
             lambda i: abs(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)))), 6)
         AS linf
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_abs_diff(spark, sf):
    e = read_table(spark, sf, "embeddings")
    a = e.select("vec_id", F.col("embedding").alias("ea"), F.col("label").alias("la"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other_id"),
                 F.col("embedding").alias("eb"), F.col("label").alias("lb"))
    d = a.join(b, "vec_id").withColumn("d", V.vector_abs_diff(F.col("ea"), F.col("eb")))
    return d.select("vec_id", "other_id", (F.col("la") == F.col("lb")).cast("int").alias("same"),
                    F.round(F.aggregate("d", F.lit(0.0), lambda acc, x: acc + x), 6).alias("l1"),
                    F.round(F.array_max("d"), 6).alias("linf"))


# ------------------------------------------------------------------------------ matchers

def _cooc_train(spark, sf, combo="td"):
    """Word co-occurrence of every pair for one feature combination (built once)."""
    vec, vocab = _vectors(spark, sf)

    def build():
        pairs = FX.split_rows(spark, sf).select("split", "pair_id", "id_left", "id_right", "label")
        return materialize(V.cooccurrence(pairs, vec.where(F.col("combo") == combo)))
    c = session_memo(spark, ("cooc", sf, combo), build)
    return c, vocab.where(F.col("combo") == combo)


@register("nb_bernoulli_model", O.with_fixtures(*_VEC_CTES) + """,
co AS (SELECT s.pair_id, s.label, list_intersect(l.idx, r.idx) AS shared
       FROM splits_v s JOIN vec l ON l.id = s.id_left AND l.combo = 'td'
       JOIN vec r ON r.id = s.id_right AND r.combo = 'td' WHERE s.split = 'train'),
nc AS (SELECT label, count(*) AS n_c FROM co GROUP BY label),
cnt AS (SELECT label, feature, count(*) AS n_cj FROM
        (SELECT label, unnest(shared) AS feature FROM co) x GROUP BY ALL),
grid AS (SELECT v.idx AS feature, l.label FROM vocab v, (VALUES (0), (1)) l(label)
         WHERE v.combo = 'td')
SELECT g.label, g.feature, round(ln((coalesce(c.n_cj, 0) + 1.0) / (n.n_c + 2.0)), 6) AS log_prob
FROM grid g JOIN nc n USING (label) LEFT JOIN cnt c USING (label, feature)
UNION ALL
SELECT label, -1, round(ln(n_c / (SELECT sum(n_c) FROM nc)), 6) FROM nc""")
def nb_bernoulli_model(spark, sf):
    c, vocab = _cooc_train(spark, sf)
    tr = c.where(F.col("split") == "train")
    p = MD.bernoulli_nb_params(tr, "shared", vocab, 1.0)
    return p.select("label", "feature", F.round("log_prob", 6).alias("log_prob"))


_GAUSS_CTES = [
    *_FEAT_CTES,
    "filled AS (SELECT split, pair_id, label, " + ", ".join(f"coalesce({c}, 0.0) AS {c}" for c in _FEAT_NAMES) + " FROM feat_v)",
    "unp AS (UNPIVOT filled ON " + ", ".join(_FEAT_NAMES) + " INTO NAME feature VALUE value)",
    "gauss AS (SELECT label, feature, avg(value) AS mean, var_pop(value) AS var FROM unp WHERE split = 'train'"
    " GROUP BY label, feature)"]


@register("nb_gaussian_model", O.with_fixtures(*_GAUSS_CTES) + """
SELECT label, feature, round(mean, 6) AS mean, round(var, 6) AS var FROM gauss""")
def nb_gaussian_model(spark, sf):
    f, plan = _features(spark, sf)
    names = [f"{a}_{m}" for a, m in plan]
    p = MD.gaussian_nb_params(f.where(F.col("split") == "train"), names)
    return p.select("label", "feature", F.round("mean", 6).alias("mean"),
                    F.round("var", 6).alias("var"))


def _model_data(spark, sf):
    """Assembled similarity features, stored once: the ML vector, the same numbers as ``values``, and
    class weights."""
    def build():
        f, plan = _features(spark, sf)
        names = [f"{a}_{m}" for a, m in plan]
        data = MD.assemble(f, names).withColumn("values", vector_to_array("features"))
        data = MD.balanced_weights(data, F.col("split") == "train")
        return materialize(EX.packed(data.select("split", "pair_id", "label", "features", "values", "weight"))), names
    return session_memo(spark, ("model_data", sf), build)


@register("model_matrix", O.with_fixtures(*_GAUSS_CTES[:-2]) + "\nSELECT split, pair_id, CAST(label AS DOUBLE) AS label, "
          + ", ".join(f"round({c}, 6) AS {c}" for c in _FEAT_NAMES) + " FROM filled")
def model_matrix(spark, sf):
    """The assembled vectors, place by place: missing measures are 0."""
    data, names = _model_data(spark, sf)
    return data.select("split", "pair_id", "label", *[F.round(F.col("values")[i], 6).alias(c) for i, c in enumerate(names)])


def _split(data, name):
    return data.where(F.col("split") == name)


def _scored(model, test, **features):
    """Rows of the stored model's tables joined to the test rows."""
    return (test.select("pair_id", F.col("label").cast("int").alias("label"))
            .join(MT.predictions(model, test, "pair_id", **features), "pair_id").withColumn("score", F.round("score", 6)))


def _predict(name):
    def run(spark, sf):
        data, _ = _model_data(spark, sf)
        train = _split(data, "train")
        model = EX.estimator(name, {"class_weight": "none"}, train.count()).fit(train)
        return _scored(model, _split(data, "test"), values="values")
    run.__name__ = f"{name}_predictions"
    return run


register("lr_predictions")(_predict("logistic_regression"))
register("svm_predictions")(_predict("linear_svm"))
register("tree_predictions")(_predict("decision_tree"))
register("forest_predictions")(_predict("random_forest"))
register("gbt_predictions")(_predict("gradient_boosting"))


@register("nb_predictions", O.with_fixtures(*_VEC_CTES) + """,
co AS (SELECT s.split, s.pair_id, s.label, list_intersect(l.idx, r.idx) AS shared
       FROM splits_v s JOIN vec l ON l.id = s.id_left AND l.combo = 'td'
       JOIN vec r ON r.id = s.id_right AND r.combo = 'td'),
nc AS (SELECT label, count(*) AS n_c FROM co WHERE split = 'train' GROUP BY label),
cnt AS (SELECT label, feature, count(*) AS n_cj FROM
        (SELECT label, unnest(shared) AS feature FROM co WHERE split = 'train') x GROUP BY ALL),
theta AS (SELECT n.label, v.idx AS feature, ln((coalesce(c.n_cj, 0) + 1.0) / (n.n_c + 2.0)) AS lp
          FROM vocab v CROSS JOIN nc n LEFT JOIN cnt c ON c.label = n.label AND c.feature = v.idx
          WHERE v.combo = 'td'),
base AS (SELECT t.label, sum(ln(1 - exp(t.lp))) + max(ln(n.n_c / (SELECT sum(n_c) FROM nc))) AS s
         FROM theta t JOIN nc n USING (label) GROUP BY t.label),
gain AS (SELECT x.pair_id, t.label, sum(t.lp - ln(1 - exp(t.lp))) AS g
         FROM (SELECT pair_id, unnest(shared) AS feature FROM co WHERE split = 'test') x
         JOIN theta t USING (feature) GROUP BY ALL),
sc AS (SELECT c.pair_id, c.label, max(CASE WHEN b.label = 0 THEN b.s + coalesce(g.g, 0) END) AS s0,
              max(CASE WHEN b.label = 1 THEN b.s + coalesce(g.g, 0) END) AS s1
       FROM co c CROSS JOIN base b LEFT JOIN gain g ON g.pair_id = c.pair_id AND g.label = b.label
       WHERE c.split = 'test' GROUP BY c.pair_id, c.label)
SELECT pair_id, label, CAST(CASE WHEN s1 > s0 THEN 1 ELSE 0 END AS INTEGER) AS prediction,
       round(CASE WHEN s0 - s1 > 700 THEN 0.0 ELSE 1 / (1 + exp(s0 - s1)) END, 6) AS score FROM sc""")
def nb_predictions(spark, sf):
    """Bernoulli naive Bayes on word co-occurrence: parameters from the train split, scoring
    of the test split from the parameter table (both distributed)."""
    c, vocab = _cooc_train(spark, sf)
    params = materialize(MD.bernoulli_nb_params(c.where(F.col("split") == "train"), "shared",
                                                vocab, 1.0))
    test = c.where(F.col("split") == "test").select("pair_id", "label", "shared")
    pred = MD.bernoulli_nb_predict(test, "pair_id", "shared", params)
    return pred.select("pair_id", F.col("label").cast("int").alias("label"),
                       F.col("prediction").cast("int").alias("prediction"),
                       F.round("score", 6).alias("score"))


def _nonzeros(df, places):
    """Rows, and words that they have in all."""
    n = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size(places).cast("long")).alias("nonzeros")).head()
    return n["rows"], n["nonzeros"] or 0


def _cooc_vectors(spark, sf, combo="td"):
    """Word co-occurrence of every pair as a sparse binary vector over the words that training pairs
    share, with class weights; those words by place; and their number."""
    def build():
        c, vocab = _cooc_train(spark, sf, combo)
        features = MT.known_features(c, F.col("split") == "train")
        placed = MT.word_places(c.select("split", "pair_id", "shared", F.col("label").cast("double").alias("label")), features, "pair_id")
        placed = MD.balanced_weights(placed.drop("shared"), F.col("split") == "train")
        width, size = max(1, features.count()), _nonzeros(c, "shared")
        return MT.binary_vectors(EX.packed_sparse(placed, *size), "places", width), features.join(vocab.select("idx", "word"), "idx"), width
    return session_memo(spark, ("cooc_vectors", sf, combo), build)


def _cooc_model(spark, sf, name):
    data, words, width = _cooc_vectors(spark, sf)
    train = _split(data, "train")
    return session_memo(spark, ("cooc_model", sf, name), lambda: EX.fit(
        name, {"class_weight": "none" if name == "naive_bayes" else "balanced"}, train, train.count(), width)), data, words


def _cooc_predict(name):
    def run(spark, sf):
        model, data, _ = _cooc_model(spark, sf, name)
        return _scored(model, _split(data, "test"), places="places")
    run.__name__ = f"cooc_{name}_predictions"
    return run


register("cooc_lr_predictions")(_cooc_predict("logistic_regression"))
register("cooc_svm_predictions")(_cooc_predict("linear_svm"))
register("cooc_tree_predictions")(_cooc_predict("decision_tree"))
register("cooc_forest_predictions")(_cooc_predict("random_forest"))
register("cooc_gbt_predictions")(_cooc_predict("gradient_boosting"))


@register("nb_top_words", O.with_fixtures(*_VEC_CTES) + """,
co AS (SELECT s.pair_id, s.label, list_intersect(l.idx, r.idx) AS shared
       FROM splits_v s JOIN vec l ON l.id = s.id_left AND l.combo = 'td'
       JOIN vec r ON r.id = s.id_right AND r.combo = 'td' WHERE s.split = 'train'),
nc AS (SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM co),
cnt AS (SELECT feature, count(*) FILTER (label = 0) AS c0, count(*) FILTER (label = 1) AS c1 FROM
        (SELECT label, unnest(shared) AS feature FROM co) x GROUP BY feature),
w AS (SELECT v.word AS name, round(ln((coalesce(c1, 0) + 1.0) / (n1 + 2.0)) - ln((coalesce(c0, 0) + 1.0) / (n0 + 2.0)), 6) AS weight
      FROM vocab v CROSS JOIN nc LEFT JOIN cnt ON cnt.feature = v.idx WHERE v.combo = 'td')
SELECT CAST(row_number() OVER (ORDER BY weight DESC, name) AS INTEGER) AS rank, name, weight FROM w
QUALIFY row_number() OVER (ORDER BY weight DESC, name) <= 100""")
def nb_top_words(spark, sf):
    """The 100 words that speak most for a match in Bernoulli naive Bayes, over the whole vocabulary."""
    c, vocab = _cooc_train(spark, sf)
    params = MD.bernoulli_nb_params(_split(c, "train"), "shared", vocab, 1.0)
    weights = MD.bernoulli_nb_importance(params).select(F.col("feature").alias("place"), F.round("weight", 6).alias("weight"))
    return MT.top_features(weights, vocab.select(F.col("idx").alias("place"), F.col("word").alias("name")))


@register("top_features")
def top_features(spark, sf):
    """The 100 features of largest weight of every learner: words on co-occurrence, measures on the
    similarity features."""
    out = None
    data, names = _model_data(spark, sf)
    by_place = spark.createDataFrame(list(enumerate(names)), "place int, name string")
    words, train = _cooc_vectors(spark, sf)[1], _split(data, "train")
    n_train = train.count()
    fits = {(learner, "words"): (lambda learner=learner: _cooc_model(spark, sf, learner)[0]) for learner in EX.LEARNERS[1:]}
    fits |= {(learner, "measures"): (lambda learner=learner: EX.estimator(learner, {"class_weight": "none"}, n_train).fit(train)) for learner in EX.LEARNERS[1:]}
    fitted = EX.run_all(fits, workers=_workers(spark))
    for learner in EX.LEARNERS[1:]:
        model, on_measures = fitted[learner, "words"], fitted[learner, "measures"]
        for features, m, n in (("words", model, words.select("place", F.col("word").alias("name"))), ("measures", on_measures, by_place)):
            top = MT.top_features(MT.importance_weights(m), n).select(F.lit(learner).alias("learner"), F.lit(features).alias("features"), "rank", "name",
                                                                      F.round("weight", 6).alias("weight"))
            out = top if out is None else out.unionByName(top)
    return out


# Settings that a search query draws for each learner (the reference draws up to 500; the cost of
# one is in the README), and the shares of training rows on which it gives them up early.
SEARCH_BUDGET, SEARCH_RUNGS = 6, (1 / 3, 1.0)


def _store(spark, label):
    return EX.ResultStore(spark, scratch_path(spark, label))


def _search(spark, sf):
    data, _ = _model_data(spark, sf)
    store = session_memo(spark, ("search_store", sf), lambda: _store(spark, "search"))
    rows = []
    for learner in EX.LEARNERS:
        fixed = {"modelType": "gaussian"} if learner == "naive_bayes" else {}
        rows += EX.search(learner, _split(data, "train"), _split(data, "valid"), SEARCH_BUDGET, rungs=SEARCH_RUNGS, store=store, **fixed)
    return rows


@register("search_results")
def search_results(spark, sf):
    """Random search of every learner over its whole grid, on the predefined validation fold (F1 of
    class 1): one row a fit, with the share of training rows it saw."""
    rows = [(r["learner"], r["setting"], EX.text_of(r["params"]), r["rung"], float(r["share"]), r["f1"]) for r in _search(spark, sf)]
    return spark.createDataFrame(rows, "learner string, setting int, params string, rung int, share double, f1 double")


@register("run_report")
def run_report(spark, sf):
    """One row per learner: the best setting of the search, refitted on all training rows, F1 on
    validation, test precision / recall / F1, training rows and seconds, and its top 100 features."""
    data, names = _model_data(spark, sf)
    by_place = spark.createDataFrame(list(enumerate(names)), "place int, name string")
    train, test = _split(data, "train"), _split(data, "test")
    found, n, rows = _search(spark, sf), train.count(), []
    for learner in EX.LEARNERS:
        best = EX.best_of([r for r in found if r["learner"] == learner])
        fixed = {"modelType": "gaussian"} if learner == "naive_bayes" else {}
        t0 = time.time()
        model = EX.estimator(learner, best["params"], n, **fixed).fit(train)
        seconds = time.time() - t0
        m = EX.f1_of(model, test)
        top = [] if learner == "naive_bayes" else MT.top_features(MT.importance_weights(model), by_place).orderBy("rank").collect()  # 100 rows
        rows.append((learner, EX.text_of(best["params"]), best["f1"], m["precision"], m["recall"], m["f1"], n, seconds,
                     ",".join(f"{r['name']}:{r['weight']:.4f}" for r in top)))
    return spark.createDataFrame(rows, "learner string, params string, valid_f1 double, precision double, recall double, "
                                 "f1 double, train_rows long, train_seconds double, top_features string")


@register("gnb_predictions", O.with_fixtures(*_GAUSS_CTES) + """,
smooth AS (SELECT 1e-9 * greatest(""" + ", ".join(f"var_pop({c})" for c in _FEAT_NAMES) + """) AS s FROM filled WHERE split = 'train'),
prior AS (SELECT label, ln(count(*) / (SELECT count(*) FROM filled WHERE split = 'train')) AS p FROM filled WHERE split = 'train' GROUP BY label),
dens AS (SELECT u.pair_id, g.label, max(p.p) + sum(-0.5 * ln(2 * pi() * (g.var + s.s)) - (u.value - g.mean) ** 2 / (2 * (g.var + s.s))) AS d
         FROM unp u JOIN gauss g ON g.feature = u.feature JOIN prior p ON p.label = g.label CROSS JOIN smooth s WHERE u.split = 'test'
         GROUP BY u.pair_id, g.label),
sc AS (SELECT pair_id, max(CASE WHEN label = 0 THEN d END) AS s0, max(CASE WHEN label = 1 THEN d END) AS s1 FROM dens GROUP BY pair_id)
SELECT f.pair_id, CAST(f.label AS INTEGER) AS label, CAST(CASE WHEN s1 > s0 THEN 1 ELSE 0 END AS INTEGER) AS prediction,
       round(CASE WHEN s0 - s1 > 700 THEN 0.0 ELSE 1 / (1 + exp(s0 - s1)) END, 6) AS score
FROM feat_v f JOIN sc ON sc.pair_id = f.pair_id WHERE f.split = 'test'""")
def gnb_predictions(spark, sf):
    """Gaussian naive Bayes on the similarity features: fitted into a parameter table on the train
    split, the test split scored from that table."""
    f, plan = _features(spark, sf)
    names = [f"{a}_{m}" for a, m in plan]
    f = materialize(f)
    params = materialize(MD.gaussian_nb_params(_split(f, "train"), names))
    pred = MD.gaussian_nb_predict(_split(f, "test"), "pair_id", names, params, _split(f, "train"))
    return pred.select("pair_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"),
                       F.round("score", 6).alias("score"))


_RUN_SCHEMA = ("file string, features string, learner string, train_rows long, flipped long, precision double, recall double, "
               "f1 double, train_seconds double")


# Boosting rounds of an experiment's cell (100 in the searches; the README has the cost of both).
EXPERIMENT_ROUNDS = 20


def _fit_cell(learner, train, test, setting, width=0, **fixed):
    n, t0 = train.count(), time.time()
    if learner == "gradient_boosting":
        fixed["maxIter"] = EXPERIMENT_ROUNDS
    model = EX.fit(learner, setting, train, n, width, **fixed)
    return {"train_rows": n, **EX.f1_of(model, test), "train_seconds": time.time() - t0}


def _workers(spark):
    """Fits at a time: most are a task at a time, so as many as there are cores."""
    return max(4, min(16, spark.sparkContext.defaultParallelism))


@register("learning_curve")
def learning_curve(spark, sf):
    """Learning curve: every learner on every feature combination and training file, F1 of class 1 on the
    test pairs. The files are nested shares of the training pairs; features are word co-occurrence of the
    three text combinations, and the similarity measures."""
    files = {"small": 0.25, "medium": 0.5, "large": 1.0}
    tables = {c: _cooc_vectors(spark, sf, c)[::2] for c in COMBOS} | {"measures": (_model_data(spark, sf)[0], 0)}

    def fit(cell):
        data, width = tables[cell["features"]]
        fixed = {"modelType": "gaussian"} if cell["learner"] == "naive_bayes" and cell["features"] == "measures" else {}
        train = EX._share_of(_split(data, "train"), "pair_id", files[cell["file"]])
        setting = {"class_weight": "none" if cell["learner"] == "naive_bayes" else "balanced"}
        return {**_fit_cell(cell["learner"], train, _split(data, "test"), setting, width, **fixed), "flipped": 0}

    cells = [{"file": f, "features": c, "learner": n} for f in files for c in tables for n in EX.LEARNERS]
    store = session_memo(spark, ("curve_store", sf), lambda: _store(spark, "learning-curve"))
    rows = EX.experiment(cells, fit, store, _workers(spark))
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in _RUN_SCHEMA.split(", ")) for r in rows], _RUN_SCHEMA)


@register("noise_experiment")
def noise_experiment(spark, sf):
    """Label-noise experiment: every learner trained on each noised copy of the train split (10
    settings) over word co-occurrence of all text attributes, F1 of class 1 on the clean test pairs."""
    from matchsmith.operators import splits as SP
    data, _, width = _cooc_vectors(spark, sf, "tdb")
    size = _nonzeros(_split(data, "train"), "places")
    labels = FX.split_rows(spark, sf).where(F.col("split") == "train").select("pair_id", "label")
    noised = session_memo(spark, ("noised", sf), lambda: materialize(
        SP.label_noise_grid(labels, "pair_id", "label").select("setting", "pair_id", F.col("label").cast("double").alias("label"), "flipped")))
    flips = {r[0]: int(r[1]) for r in noised.groupBy("setting").agg(F.sum(F.col("flipped").cast("long"))).collect()}  # a row a setting
    copies = EX.run_all({s: (lambda s=s: materialize(EX.packed_sparse(_split(data, "train").drop("label", "weight").join(
        noised.where(F.col("setting") == s).select("pair_id", "label"), "pair_id"), *size))) for s in sorted(flips)}, workers=_workers(spark))

    def fit(cell):
        return {**_fit_cell(cell["learner"], copies[cell["file"]], _split(data, "test"), {"class_weight": "none"}, width), "flipped": flips[cell["file"]]}

    cells = [{"file": s, "features": "tdb", "learner": n} for s in sorted(flips) for n in EX.LEARNERS]
    store = session_memo(spark, ("noise_store", sf), lambda: _store(spark, "noise"))
    rows = EX.experiment(cells, fit, store, _workers(spark))
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in _RUN_SCHEMA.split(", ")) for r in rows], _RUN_SCHEMA)
