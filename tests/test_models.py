import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchsmith.plans import experiments as EX
from matchsmith.plans import model_tables as MT
from matchsmith.plans import models as MD
from matchsmith.session import scratch_path



def binary_vectorizer(vocab, input_col, output_col):
    """Test helper: Spark ML CountVectorizerModel over a tiny vocabulary, to feed Spark ML's
    NaiveBayes as the reference implementation."""
    from pyspark.ml.feature import CountVectorizerModel
    words = [r[0] for r in vocab.orderBy("idx").select("word").collect()]
    return CountVectorizerModel.from_vocabulary(words, inputCol=input_col, outputCol=output_col,
                                                binary=True)


def test_bernoulli_params_equal_spark_ml(spark):
    rnd = random.Random(0)
    rows = [(i, i % 2, sorted(rnd.sample(range(6), rnd.randint(0, 4)))) for i in range(60)]
    df = spark.createDataFrame(rows, "pair_id long, label int, shared array<long>")
    p = {(r.label, r.feature): r.log_prob for r in MD.bernoulli_nb_params(
        df, "shared", spark.range(6).select(F.col("id").alias("idx"))).collect()}
    words = df.withColumn("w", F.transform("shared", lambda i: F.concat(F.lit("w"), i.cast("string"))))
    vocab = spark.createDataFrame([(f"w{i}", i) for i in range(6)], "word string, idx long")
    cv = binary_vectorizer(vocab, "w", "features")
    d = cv.transform(words).withColumn("label", F.col("label").cast("double"))
    m = MD.spark_nb("bernoulli").fit(d)
    theta = m.theta.toArray()
    for c in (0, 1):
        for j in range(6):
            assert p[(c, j)] == pytest.approx(theta[c][j])
        assert p[(c, -1)] == pytest.approx(m.pi.toArray()[c])
    # distributed scoring from the parameter table equals Spark ML's predictions
    params = MD.bernoulli_nb_params(df, "shared", spark.range(6).select(F.col("id").alias("idx")))
    ours = {r.pair_id: (r.prediction, r.score) for r in
            MD.bernoulli_nb_predict(df, "pair_id", "shared", params).collect()}
    from pyspark.ml.functions import vector_to_array
    ml = m.transform(d).select("pair_id", "prediction",
                               vector_to_array("probability").getItem(1).alias("p1")).collect()
    for r in ml:
        assert ours[r.pair_id][0] == int(r.prediction)
        assert ours[r.pair_id][1] == pytest.approx(r.p1, abs=1e-9)


def separable(spark, n=300):
    rnd = random.Random(1)
    rows = []
    for i in range(n):
        y = i % 2
        rows.append((i, y, "train" if i < 200 else ("valid" if i < 250 else "test"),
                     y + rnd.random() * 0.4 + (rnd.random() < 0.05), rnd.random()))
    df = spark.createDataFrame(rows, "pair_id long, label int, split string, a double, b double")
    data = MD.balanced_weights(MD.assemble(df, ["a", "b"]).withColumn("values", F.array("a", "b")), F.col("split") == "train")
    return [data.where(F.col("split") == s).cache() for s in ("train", "valid", "test")]


TREES = {"decision_tree": {}, "random_forest": {"numTrees": 7}, "gradient_boosting": {"maxIter": 5}}


@pytest.mark.parametrize("name", EX.LEARNERS[1:])
def test_model_tables_score_as_spark_ml(spark, name):
    """Dense rows: predictions and scores from the stored tables equal the model's own."""
    train, _, test = separable(spark)
    model = EX.estimator(name, {"class_weight": "balanced"}, 200, **TREES.get(name, {})).fit(train)
    ours = {r.pair_id: (r.prediction, r.score) for r in MT.predictions(model, test, "pair_id", values="values").collect()}
    theirs = model.transform(test)
    theirs = theirs.select("pair_id", "prediction", MD.score_column(theirs).alias("score")).collect()
    assert len(ours) == len(theirs) == 50
    for r in theirs:
        assert ours[r.pair_id][0] == int(r.prediction) and ours[r.pair_id][1] == pytest.approx(r.score, abs=1e-9)
    assert sum(ours[r.pair_id][0] == r.pair_id % 2 for r in theirs) > 42
    top = MT.top_features(MT.importance_weights(model), spark.createDataFrame([(0, "a"), (1, "b")], "place int, name string")).collect()
    assert top[0].name == "a" and top[0]["rank"] == 1


def test_stored_tree_scored_in_sql(spark):
    """A forest's node table, scored by a recursive query in another engine."""
    import duckdb
    train, _, test = separable(spark)
    model = EX.estimator("random_forest", {}, 200, numTrees=5, maxDepth=4).fit(train)
    n, r = MT.tree_nodes(MT.stored(model)).withColumnsRenamed({"left": "lower", "right": "upper"}).toPandas(), test.select("pair_id", F.col("values").alias("x")).toPandas()  # noqa: F841
    n["stats"] = n["stats"].map(list)
    r["x"] = r["x"].map(list)
    got = duckdb.sql("""
        WITH RECURSIVE walk AS (
          SELECT r.pair_id, r.x, n.tree, 0 AS node FROM r, (SELECT DISTINCT tree FROM n) n
          UNION ALL
          SELECT a.pair_id, a.x, a.tree, CASE WHEN a.x[n.feature + 1] <= n.threshold THEN n.lower ELSE n.upper END AS node
          FROM walk a JOIN n ON n.tree = a.tree AND n.node = a.node WHERE n.feature >= 0)
        SELECT a.pair_id, avg(n.stats[2] / list_sum(n.stats)) AS score
        FROM walk a JOIN n ON n.tree = a.tree AND n.node = a.node WHERE n.feature < 0 GROUP BY a.pair_id""").fetchall()
    ours = {r.pair_id: r.score for r in MT.predictions(model, test, "pair_id", values="values").collect()}
    assert {k: pytest.approx(v, abs=1e-9) for k, v in got} == ours


def cooc_pairs(spark, extra=0):
    """Pairs over a vocabulary; with ``extra``, so many words that no pair shares lie before and between them."""
    rnd = random.Random(2)
    step = 1 + extra // 40
    rows = []
    for i in range(160):
        y = i % 2
        words = sorted(set(rnd.sample(range(20), 4) + ([20 + i % 3] if y else [])))
        rows.append((i, y, "train" if i < 120 else "test", [w * step + extra for w in words]))
    return spark.createDataFrame(rows, "pair_id long, label int, split string, shared array<long>")


def test_vectors_do_not_depend_on_unrelated_words(spark):
    """20,000 and more words join the vocabulary: vectors, importances and predictions stay."""
    found = []
    for extra in (0, 20_000):
        df = cooc_pairs(spark, extra).withColumn("label", F.col("label").cast("double"))
        features = MT.known_features(df, F.col("split") == "train")
        data = MT.binary_vectors(MT.word_places(df, features, "pair_id"), "places", features.count()).cache()
        assert data.schema["features"].dataType.typeName() == "vector" or "vector" in data.schema["features"].dataType.simpleString()
        for r in data.collect():
            assert r.features.size == 23 and sorted(r.features.indices) == r.places and set(r.features.values) <= {1.0}
        train, test = (data.where(F.col("split") == s) for s in ("train", "test"))
        out = [[(r.pair_id, r.features) for r in data.orderBy("pair_id").collect()]]
        for name in ("logistic_regression", "random_forest"):
            model = EX.estimator(name, {}, 120, **TREES.get(name, {})).fit(train)
            ours = {r.pair_id: (r.prediction, r.score) for r in MT.predictions(model, test, "pair_id", places="places").collect()}
            theirs = model.transform(test)
            for r in theirs.select("pair_id", "prediction", MD.score_column(theirs).alias("score")).collect():
                assert ours[r.pair_id][0] == int(r.prediction) and ours[r.pair_id][1] == pytest.approx(r.score, abs=1e-9)
            out.append({k: (p, round(s, 9)) for k, (p, s) in ours.items()})
        found.append(out)
    assert found[0] == found[1]


def test_search_rungs_store_and_resume(spark):
    train, valid, _ = separable(spark)
    store = EX.ResultStore(spark, scratch_path(spark, "store"))
    rows = EX.search("decision_tree", train, valid, budget=6, rungs=(0.5, 1.0), store=store)
    assert [r["rung"] for r in rows].count(0) == 6 and [r["rung"] for r in rows].count(1) == 2
    assert store.read().count() == 8
    first = [r for r in rows if r["rung"] == 0]
    kept = {r["setting"] for r in sorted(first, key=lambda r: (-r["f1"], r["setting"]))[:2]}
    assert {r["setting"] for r in rows if r["rung"] == 1} == kept
    best = EX.best_of(rows)
    exact = EX.estimator("decision_tree", best["params"], train.count()).fit(train)
    assert best["f1"] == pytest.approx(EX.f1_of(exact, valid)["f1"])
    calls, fit = [], EX.estimator
    EX.estimator = lambda *a, **k: calls.append(a) or fit(*a, **k)
    try:
        assert EX.search("decision_tree", train, valid, budget=6, rungs=(0.5, 1.0), store=store) == rows and not calls
    finally:
        EX.estimator = fit
    with pytest.raises(ValueError):
        EX.search("decision_tree", train, valid, rungs=(0.5,))


def test_grids_and_settings():
    sizes = {n: len(EX.settings(n, 10 ** 6)) for n in EX.LEARNERS if n != "gradient_boosting"}
    assert sizes == {"naive_bayes": 1, "logistic_regression": 16, "linear_svm": 16, "decision_tree": 32, "random_forest": 96}
    drawn = EX.settings("gradient_boosting", 500)
    assert len(drawn) == 500 == len({EX.text_of(s) for s in drawn}) and drawn == EX.settings("gradient_boosting", 500)
    est = EX.estimator("logistic_regression", {"C": 10.0, "class_weight": "balanced"}, 50)
    assert est.getRegParam() == pytest.approx(1 / 500) and est.getWeightCol() == "weight"


def test_experiment_resumes_after_a_lost_driver(spark):
    store, ran = EX.ResultStore(spark, scratch_path(spark, "store")), []

    def fit(cell):
        ran.append(cell["learner"])
        if cell["learner"] == "c" and ran.count("c") == 1:
            raise RuntimeError("lost")
        return {"f1": ord(cell["learner"]) / 100}

    cells = [{"file": "f", "learner": n} for n in "abcd"]
    with pytest.raises(RuntimeError):
        EX.experiment(cells, fit, store, workers=1)
    held = store.read().count()
    rows = EX.experiment(cells, fit, store, workers=1)
    assert [r["f1"] for r in rows] == [0.97, 0.98, 0.99, 1.0] and held >= 2
    assert store.read().count() == 4 and ran.count("a") == ran.count("b") == 1


def test_gaussian_nb_equals_the_formula(spark):
    train, _, test = separable(spark)
    train, test = train.drop("features"), test.drop("features")
    params = MD.gaussian_nb_params(train, ["a", "b"])
    got = {r.pair_id: (r.prediction, r.score) for r in MD.gaussian_nb_predict(test, "pair_id", ["a", "b"], params, train).collect()}
    x = np.array([[r.a, r.b] for r in train.collect()])
    y = np.array([r.label for r in train.collect()])
    smooth = 1e-9 * x.var(axis=0).max()
    for r in test.collect():
        s = [np.log((y == c).mean()) + sum(-0.5 * np.log(2 * np.pi * (v + smooth)) - (z - m) ** 2 / (2 * (v + smooth))
                                           for z, m, v in zip((r.a, r.b), x[y == c].mean(axis=0), x[y == c].var(axis=0))) for c in (0, 1)]
        assert got[r.pair_id][0] == int(s[1] > s[0]) and got[r.pair_id][1] == pytest.approx(1 / (1 + np.exp(s[0] - s[1])), abs=1e-9)


def test_balanced_weights(spark):
    df = spark.createDataFrame([(1.0, "train")] * 1 + [(0.0, "train")] * 3 + [(1.0, "test")], "label double, split string")
    weights = {r["label"]: r["weight"] for r in MD.balanced_weights(df, F.col("split") == "train").collect()}
    assert weights == {1.0: 2.0, 0.0: 4 / 6}


def test_wide_rows_are_spread_over_partitions(spark):
    """A fit on many features isn't one task, however few its rows."""
    df = spark.range(2000).select(F.col("id").cast("string").alias("pair_id"))
    assert EX.packed(df, 40_000).rdd.getNumPartitions() == 10
    assert EX.packed(df, 100).rdd.getNumPartitions() == EX.packed(df).rdd.getNumPartitions() == 1
