"""Trees grown from the nonzeros of 0/1 rows, held against Spark ML's own."""

import random
from multiprocessing.pool import ThreadPool

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchsmith.plans import experiments as EX
from matchsmith.plans import model_tables as MT
from matchsmith.plans import models as MD
from matchsmith.plans import sparse_trees as ST

WIDTH = 30


def words(spark, n=600, seed=3):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        y = int(rnd.random() < 0.4)
        held = [w for w in range(WIDTH) if rnd.random() < 0.1 + 0.02 * w / 3 * (y if w % 2 else 1 - y / 2)]
        rows.append((i, float(y), "train" if i < n * 3 // 4 else "test", held))
    df = spark.createDataFrame(rows, "pair_id long, label double, split string, places array<int>")
    return MT.binary_vectors(MD.balanced_weights(df, F.col("split") == "train"), "places", WIDTH)


@pytest.fixture(scope="module")
def data(spark):
    return words(spark)


def scores(model, rows):
    return {r.pair_id: (r.prediction, pytest.approx(r.score, abs=1e-9)) for r in MT.predictions(model, rows, "pair_id", places="places").collect()}


def weights(model):
    return {r.place: pytest.approx(r.weight, abs=1e-9) for r in MT.importance_weights(model).collect()}


@pytest.mark.parametrize("name, params", [
    ("decision_tree", {}), ("decision_tree", {"maxDepth": 8, "minInstancesPerNode": 10}), ("decision_tree", {"minInfoGain": 0.01, "minWeightFractionPerNode": 0.05}),
    ("random_forest", {"numTrees": 1, "bootstrap": False, "featureSubsetStrategy": "all"}),
    ("gradient_boosting", {"maxIter": 12, "maxDepth": 2}), ("gradient_boosting", {"maxIter": 4, "maxDepth": 3, "minInstancesPerNode": 20})])
@pytest.mark.parametrize("kept", [1 << 22, 20])
def test_equals_spark_ml(data, monkeypatch, name, params, kept):
    """Where no rows or features are drawn: scores and importances, whether or not sums are kept from level to level."""
    monkeypatch.setattr(ST, "SUMS_KEPT", kept)
    train, test = (data.where(F.col("split") == s) for s in ("train", "test"))
    est = EX.estimator(name, {"class_weight": "balanced"}, 450, **params)
    ours, theirs = ST.fit(est, train, WIDTH), est.fit(train)
    assert scores(ours, test) == scores(theirs, test)
    assert weights(ours) == weights(theirs)
    assert EX.f1_of(ours, test) == pytest.approx(EX.f1_of(theirs, test))


def test_several_tasks_grow_the_same_trees(data, monkeypatch):
    """Features dealt over the tasks of a barrier stage; a forest whose trees are grown in step."""
    train = data.where(F.col("split") == "train")
    for name, params in (("decision_tree", {"maxDepth": 3}), ("random_forest", {"numTrees": 6, "maxDepth": 3}), ("gradient_boosting", {"maxIter": 2, "maxDepth": 2})):
        est = EX.estimator(name, {"class_weight": "balanced"}, 450, **params)
        one = ST.fit(est, train, WIDTH)
        with monkeypatch.context() as m:
            m.setattr(ST, "NONZEROS_OF_A_TASK", 900)
            several = ST.fit(est, train, WIDTH)
        assert [(w, [vars(x) for x in nodes]) for w, nodes in one.trees] == [(w, [vars(x) for x in nodes]) for w, nodes in several.trees] or name == "random_forest"
        assert [[x.feature for x in nodes] for _, nodes in one.trees] == [[x.feature for x in nodes] for _, nodes in several.trees]


def test_forest_draws(data):
    """Draws go by the rows' keys: neither their order nor their partitions count. Each tree sees other rows and features."""
    train, test = (data.where(F.col("split") == s) for s in ("train", "test"))
    est = EX.estimator("random_forest", {"class_weight": "balanced"}, 450, numTrees=40)
    a, b = ST.fit(est, train, WIDTH), ST.fit(est, train.repartition(5).sortWithinPartitions(F.desc("pair_id")), WIDTH)
    assert [[x.feature for x in nodes] for _, nodes in a.trees] == [[x.feature for x in nodes] for _, nodes in b.trees]
    assert len({tuple(x.feature for x in nodes) for _, nodes in a.trees}) == 40 and len({nodes[0].n for _, nodes in a.trees}) > 10
    assert len({nodes[0].feature for _, nodes in a.trees}) > 5
    theirs = EX.f1_of(est.fit(train), test)["f1"]
    assert EX.f1_of(a, test)["f1"] == pytest.approx(theirs, abs=0.1)
    drawn = ST._poisson(ST._hashed(np.arange(100_000), 42), 1.0)
    assert np.bincount(drawn)[:4] / 100_000 == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613], abs=0.01)


def test_wide_rows_are_not_made_dense(spark, monkeypatch):
    """400 rows of 40,000 features, 16 million cells: trees from 2,500 nonzeros, in a thread of a pool; the same as of the same
    words under other numbers."""
    step = 40_000 // WIDTH
    narrow = words(spark, 400, 5)
    wide = MT.binary_vectors(narrow.drop("features").withColumn("places", F.transform("places", lambda p: (p * step).cast("int"))), "places", 40_000)
    est = EX.estimator("decision_tree", {}, 300)
    monkeypatch.setattr(type(est), "fit", lambda *a: pytest.fail("dense rows"))
    found = []
    for rows, width in ((wide, 40_000), (narrow, WIDTH)):
        if width == WIDTH:
            monkeypatch.setattr(EX, "CELLS_OF_A_PARTITION", 0)
        train, test = (rows.where(F.col("split") == s) for s in ("train", "test"))
        with ThreadPool(1) as pool:
            model, f1 = pool.apply(lambda: (m := EX.fit("decision_tree", {"class_weight": "balanced"}, train, 300, width), EX.f1_of(m, test)))
        found.append(([x.prediction for _, nodes in model.trees for x in nodes], f1))
    assert found[0] == found[1]


def test_sparse_rows_are_packed_by_their_nonzeros(spark):
    """As many features as there may be, a fit that reads nonzeros alone isn't cut into a task for every few of them."""
    df = spark.range(2000).select(F.col("id").cast("string").alias("pair_id"))
    assert EX.packed_sparse(df, 2000, 50_000).rdd.getNumPartitions() == 1
    assert EX.packed_sparse(df, 2000, 5 * EX.NONZEROS_OF_A_PARTITION).rdd.getNumPartitions() == 5
    assert EX.packed_sparse(df, 3 * EX.ROWS_OF_A_PARTITION, 10).rdd.getNumPartitions() == 3


def test_a_tree_without_a_split(spark):
    rows = [(i, 1.0, [0], 1.0) for i in range(20)] + [(20 + i, 1.0, [], 1.0) for i in range(5)]
    train = spark.createDataFrame(rows, "pair_id long, label double, places array<int>, weight double")
    model = ST.fit(EX.estimator("decision_tree", {}, 25), train, 1)
    assert model.depth == 0 and MT.importance_weights(model).count() == 0
    assert {(r.prediction, r.score) for r in MT.predictions(model, train, "pair_id", places="places").collect()} == {(1, 1.0)}


def test_a_feature_twice_in_a_row_is_an_error(spark):
    """As it is in a vector: the row would count twice."""
    train = spark.createDataFrame([(1, 1.0, [0, 0], 1.0), (2, 0.0, [1], 1.0)], "pair_id long, label double, places array<int>, weight double")
    with pytest.raises(Exception, match="places must rise"):
        ST.fit(EX.estimator("decision_tree", {}, 2), train, 2)
