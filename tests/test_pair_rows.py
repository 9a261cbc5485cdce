"""Pairs and entities by row numbers, and packed token sets, against their plain forms."""

import random

import numpy as np
from pyspark.sql import functions as F

from matchsmith.functions import similarity as S
from matchsmith.functions import text as T
from matchsmith.functions import tokensets as TS
from matchsmith.operators import shape as SH
from matchsmith.plans import features as FE
from matchsmith.sources import fixtures as FX

ATTRS = ["title", "description", "brand"]


def _documents(spark, tmp_path):
    rng = random.Random(5)
    words = ["alpha", "Bêta", "gam-ma", "d\U0001F600lta", "epsi\nlon", "z"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 12, 30]))), rng.choice("ab"), rng.choice("xy")) for i in range(60)]
    rows += [(60, None, "a", "x"), (61, "", "b", "y"), (7, rows[7][1], "c", rows[7][3]), (None, "no id", "a", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def _rows(df):
    return sorted(df.collect(), key=repr)


def test_stored_pairs_hold_no_descriptions_and_give_the_wide_ones(spark, tmp_path):
    sf = _documents(spark, tmp_path)
    stored = FX.pair_rows(spark, sf)
    assert not {"description_left", "description_right"} & set(stored.columns)
    o = FX.offers(spark, sf)
    a, b = (o.select(*[F.col(c).alias(f"{c}_{s}") for c in o.columns]) for s in ("left", "right"))
    plain = FX.pair_ids(spark, sf).join(a, "id_left").join(b, "id_right").withColumn("label", (F.col("cluster_id_left") == F.col("cluster_id_right")).cast("int"))
    wide = FX.pairs(spark, sf)
    assert _rows(wide) == _rows(plain.select(*wide.columns))
    there = stored.select("pair_id", "description_filled_left").distinct()
    assert _rows(there) == _rows(wide.select("pair_id", F.expr("coalesce(description_left <> '', false)").alias("description_filled_left")).distinct())


def test_entities_by_rows_are_the_first_occurrences(spark, tmp_path):
    sf = _documents(spark, tmp_path)
    by_rows = SH.entity_table(FX.pair_rows(spark, sf), ATTRS, rows=FX.offer_rows(spark, sf))
    assert _rows(by_rows) == _rows(SH.entity_table(FX.pairs(spark, sf), ATTRS))


def test_measures_of_packed_sets_on_pairs_without_descriptions(spark, tmp_path):
    sf = _documents(spark, tmp_path)
    plan = FE.feature_plan({"title": "str_gt_10w", "description": "str_gt_10w", "brand": "str_eq_1w"}, include_align=False)
    ents = SH.entity_table(FX.pair_rows(spark, sf), ATTRS, rows=FX.offer_rows(spark, sf))
    lean = FE.pair_features(FX.split_rows(spark, sf), plan, ["split", "pair_id", "label"], entities=ents)
    each = FE.pair_features(FX.splits(spark, sf), plan, ["split", "pair_id", "label"])
    assert _rows(lean) == _rows(each)


def test_packed_sets_hold_every_token(spark):
    texts = ["", "a", "aaaa", "abcabc d", "\U0001F600é\U0001F600 é x", "wide 　 space\x1fhere", "many " * 500 + "ends"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", TS.PACK["qg3"]("t").alias("q"), TS.PACK["ws"]("t").alias("w"), F.array_distinct(S.qgram_codes(F.col("t"))).alias("codes"),
        F.array_distinct(T.split_ws(F.col("t"))).alias("words"))
    for r in df.collect():
        held = TS.unpack_codes(bytes(r["q"]["packed"])) if r["t"] else np.array([])
        assert held.tolist() == sorted(r["codes"]) and r["q"]["n"] == len(r["codes"])
        assert r["w"]["n"] == len(r["words"])
    assert df.where("t = 'abcabc d'").select(F.octet_length("q.packed")).head()[0] < 8 * 8


def test_words_of_all_combinations_go_as_one_row(spark):
    from matchsmith.operators import vectors as V
    combos = {"t": ["title"], "td": ["title", "description"], "tdb": ["title", "description", "brand"]}
    rows = [(1, "Red red shoe_1 \u03a3\u039f\u03a3", "shoe_1 in red, x", "acme"), (2, None, "in \u03c3\u03bf\u03c2 red", ""), (3, "", None, "acme in"), (4, "acme", "", None)]
    ents = spark.createDataFrame(rows, "id long, title string, description string, brand string")
    text = lambda r, cols: T.combine([F.col(c) for c in cols])
    plain = {}
    for name, cols in combos.items():
        for r in ents.select("id", F.array_distinct(T.vocab_tokens(text(None, cols))).alias("w")).collect():
            plain[name, r["id"]] = set(r["w"])
    df = {}
    for (name, _), held in plain.items():
        for w in held:
            df[name, w] = df.get((name, w), 0) + 1
    kept = {name: sorted(w for n, w in df if n == name and df[n, w] >= 2) for name in combos}
    vocab = V.vocabulary(ents, combos, 2)
    assert {(r["combo"], r["word"], r["df"], r["idx"]) for r in vocab.collect()} == {
        (n, w, df[n, w], i) for n, ws in kept.items() for i, w in enumerate(ws)}
    got = {(r["combo"], r["id"]): r["idx"] for r in V.word_vectors(ents, combos, vocab).collect()}
    assert got == {(n, i): [kept[n].index(w) for w in sorted(held) if w in kept[n]] for (n, i), held in plain.items()}
    assert V.doc_words(ents, combos).where("id = 1").count() == len(plain["tdb", 1])


def test_sets_and_counts_by_row_hold_no_texts_in_joins(spark, tmp_path):
    sf = _documents(spark, tmp_path)
    rows, s = FX.offer_rows(spark, sf), FX.split_rows(spark, sf)
    ents, named = SH.entity_table(s, ATTRS, rows=rows), SH.entity_rows(s)
    assert _rows(FE.attribute_types(named, ATTRS, rows)) == _rows(FE.attribute_types(ents, ATTRS))
    plan = FE.feature_plan({"title": "str_gt_10w", "description": "str_gt_10w", "brand": "str_eq_1w"}, include_align=False)
    keep = ["split", "pair_id", "label"]
    assert _rows(FE.pair_features(s, plan, keep, entities=named, rows=rows)) == _rows(FE.pair_features(s, plan, keep, entities=ents))


def test_more_words_than_is_the_word_count(spark):
    df = spark.createDataFrame([(t,) for t in (None, "", " ", "a", " a b ", "a b c", "\n a\tb  c ", "a b c d e ", "  a b c d e f g")], "t string")
    for n in range(7):
        assert df.where(T.more_words_than(F.col("t"), n) != (T.word_count(F.col("t")) > n)).count() == 0


def test_ranked_offers_are_made_of_one_stored_table(spark, tmp_path, monkeypatch):
    from matchsmith.plans import training_sets as TSETS
    seen, keep = [], TSETS.materialize
    monkeypatch.setattr(TSETS, "materialize", lambda df, *a: seen.append(keep(df, *a)) or seen[-1])
    sf = _documents(spark, tmp_path)
    parts = TSETS.prepare(FX.offers(spark, sf), FX.gold(spark, sf), TSETS.SamplingConfig())
    assert [sorted(t.columns) for t in seen] == [["cluster_id", "id", "title"], ["bad", "cluster_id", "id", "title"], ["bad", "cluster_id", "id", "rank", "title"]]
    assert parts.clean is seen[0]


def _labelled(spark, sf):
    """Pairs and labels by way of the wide joins, and the hex digit that names the valid and the gold ones."""
    plain = FX._pair_rows(spark, sf).select("pair_id", "id_left", "id_right", "label")
    digit = lambda kind: F.substring(F.md5(F.concat(F.lit(f"{kind}|"), "pair_id")), 1, 1)
    return plain, digit("valid").isin("0", "1", "2"), digit("gold").isin("e", "f")


def _no_titles(monkeypatch):
    monkeypatch.setattr(FX, "pair_rows", None)
    monkeypatch.setattr(FX, "offers", None)


def test_label_noise_joins_no_titles(spark, tmp_path, monkeypatch):
    from matchsmith.plans import catalog_more
    sf = _documents(spark, tmp_path)
    plain, _, gold = _labelled(spark, sf)
    _no_titles(monkeypatch)
    assert _rows(FX.pair_labels(spark, sf)) == _rows(plain) and plain.count() > plain.distinct().count()
    assert _rows(FX.gold(spark, sf)) == _rows(plain.where(gold))
    noisy = catalog_more.label_noise(spark, sf)
    back = noisy.select("pair_id", F.when(F.col("flipped"), 1 - F.col("label")).otherwise(F.col("label")).alias("label"))
    assert _rows(back) == _rows(plain.select("pair_id", "label"))
    assert noisy.where("flipped").count() == sum(r["count"] // 10 for r in plain.groupBy("label").count().collect())


def test_splits_by_ids_join_no_titles(spark, tmp_path, monkeypatch):
    from matchsmith.plans import catalog_more
    sf = _documents(spark, tmp_path)
    plain, valid, _ = _labelled(spark, sf)
    _no_titles(monkeypatch)
    assert _rows(catalog_more.split_train(spark, sf)) == _rows(plain.where(~valid).select("pair_id", "label"))
    assert _rows(catalog_more.split_valid(spark, sf)) == _rows(plain.where(valid).select("pair_id", "label"))


def test_cluster_share_stores_no_texts(spark, tmp_path, monkeypatch):
    from matchsmith.plans import catalog
    from matchsmith.plans import training_sets as TSETS
    sf = _documents(spark, tmp_path)
    plain, _, gold = _labelled(spark, sf)
    held = plain.where(gold).where("id_left <> id_right").select(F.explode(F.array("id_left", "id_right")).alias("id")).distinct()
    clusters = FX.offers(spark, sf).join(held, "id").select("cluster_id").distinct()
    _no_titles(monkeypatch)
    assert _rows(catalog.gold_clusters(spark, sf)) == _rows(clusters)
    assert _rows(catalog.cluster_share(spark, sf)) == _rows(TSETS.select_clusters(clusters, 0.5, catalog.CFG.seed))
