"""Feature vectors and fitted models as tables.

Sparse vectors are written as plain columns and read back as ML vectors, so the JVM builds them and no
vocabulary visits the driver. Fitted trees and coefficients are tables of nodes and weights; rows are scored by joining
them, whatever built the model. Importances are joined to the words of the vocabulary.
"""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from matchsmith.operators.joins import bounded_broadcast
from matchsmith.operators.keys import dense_positions
from matchsmith.plans.sparse_trees import SparseTrees
from matchsmith.session import materialize, scratch_path


def known_features(df: DataFrame, train: Column, idx_col: str = "shared") -> DataFrame:
    """``idx, place``: the vocabulary indices that some training row holds, numbered in their order.
    An index no training row holds carries no weight in any model, so words that join the
    vocabulary elsewhere change neither the vectors nor a fit on them."""
    held = df.where(train).select(F.explode(idx_col).alias("idx")).distinct().withColumn("_all", F.lit(0))
    return materialize(dense_positions(held, ["idx"], ["_all"], "place").select("idx", "place"))


def word_places(df: DataFrame, features: DataFrame, key: str, idx_col: str = "shared") -> DataFrame:
    """``df`` with ``places``: the sorted feature places of each row's indices (one row a key)."""
    held = (df.select(key, F.explode(idx_col).alias("idx")).join(features, "idx")
            .groupBy(key).agg(F.array_sort(F.collect_list(F.col("place").cast("int"))).alias("places")))
    return df.join(held, key, "left").withColumn("places", F.coalesce("places", F.array().cast("array<int>")))


def binary_vectors(df: DataFrame, places: str, width: int, out: str = "features") -> DataFrame:
    """``df`` with a sparse 0/1 vector of ``width`` places, built in the JVM: an ML vector's stored
    form is a struct, so the column is written as one and read back under the vector type."""
    spark = df.sparkSession
    struct = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(width).alias("size"), F.col(places).alias("indices"),
                      F.transform(places, lambda _: F.lit(1.0)).alias("values"))
    path = scratch_path(spark, "vectors")
    df.withColumn(out, struct).write.parquet(path)
    schema = TY.StructType([*df.schema.fields, TY.StructField(out, VectorUDT())])
    return spark.read.schema(schema).parquet(path)


# ------------------------------------------------------------------------------ stored models

def stored(model, label: str = "model") -> str:
    """Path of the saved model in the shared folder."""
    path = scratch_path(SparkSession.getActiveSession(), label)
    model.write().save(path)
    return path


def linear_weights(model) -> DataFrame:
    """``place, weight`` of a linear model's coefficients other than zero, and its intercept at
    place -1."""
    spark = SparkSession.getActiveSession()
    row = spark.createDataFrame([(model.coefficients.toArray().tolist(), float(model.intercept))], "w array<double>, b double")
    return (row.select(F.posexplode("w").alias("place", "weight")).where("weight <> 0")
            .unionByName(row.select(F.lit(-1).alias("place"), F.col("b").alias("weight"))))


def tree_nodes(path: str) -> DataFrame:
    """``tree, tree_weight, node, feature, threshold, left, right, prediction, stats`` of a saved tree,
    forest or boosted ensemble of continuous features; ``feature`` is -1 in leaves."""
    spark = SparkSession.getActiveSession()
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "metadata", "tree_weight").drop("metadata")
        data = data.select(F.col("treeID").alias("tree"), "nodeData.*").join(weights, "tree")
    else:
        data = data.withColumns({"tree": F.lit(0), "tree_weight": F.lit(1.0)})
    threshold = F.when(F.size("split.leftCategoriesOrThreshold") > 0, F.element_at("split.leftCategoriesOrThreshold", 1))
    return data.select("tree", "tree_weight", F.col("id").alias("node"), F.col("split.featureIndex").alias("feature"), threshold.alias("threshold"),
                       F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), "prediction", F.col("impurityStats").alias("stats"))


def score_linear(rows: DataFrame, key: str, weights: DataFrame, values: str | None = None, places: str | None = None) -> DataFrame:
    """``key, margin`` of each row from the weight table; a row's features are a dense array
    ``values`` or the ``places`` of its ones."""
    held = rows.select(key, F.posexplode(values).alias("place", "value")) if values else \
        rows.select(key, F.explode(places).alias("place"), F.lit(1.0).alias("value"))
    gain = held.join(bounded_broadcast(weights.where("place >= 0")), "place").groupBy(key).agg(F.sum(F.col("weight") * F.col("value")).alias("gain"))
    base = weights.where("place < 0").head()["weight"]  # one row
    return rows.select(key).join(gain, key, "left").select(key, (F.coalesce("gain", F.lit(0.0)) + F.lit(base)).alias("margin"))


def score_trees(rows: DataFrame, key: str, nodes: DataFrame, depth: int, values: str | None = None, places: str | None = None) -> DataFrame:
    """``key, tree, tree_weight, prediction, stats`` of the leaf that each row reaches in each tree:
    a join with the node table a level."""
    nodes = materialize(nodes)
    held = bounded_broadcast(nodes)
    value = (lambda f: F.element_at(F.col(values), f + 1)) if values else (lambda f: F.array_contains(places, f).cast("double"))
    at = rows.select(key, values or places, F.explode(F.sequence(F.lit(0), F.lit(nodes.agg(F.max("tree")).head()[0]))).alias("tree"), F.lit(0).alias("node"))
    for _ in range(depth):
        here = at.join(held.select("tree", "node", "feature", "threshold", "left", "right"), ["tree", "node"])
        step = F.when(F.col("feature") < 0, F.col("node")).when(value(F.greatest("feature", F.lit(0))) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        at = here.select(key, values or places, "tree", step.alias("node"))
    return at.join(held, ["tree", "node"]).select(key, "tree", "tree_weight", "prediction", "stats")


def _share(stats: str) -> Column:
    """The share of class 1 in a leaf's weighted class counts."""
    return F.element_at(stats, 2) / F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)


def predictions(model, rows: DataFrame, key: str, values: str | None = None, places: str | None = None) -> DataFrame:
    """``key, prediction, score`` of a fitted model, from its tables: probability of class 1, or the
    margin of a linear SVM."""
    kind = type(model).__name__
    if kind.startswith("LogisticRegression") or kind.startswith("LinearSVC"):
        m = score_linear(rows, key, linear_weights(model), values, places)
        score = 1 / (1 + F.exp(-F.col("margin"))) if kind.startswith("Logistic") else F.col("margin")
        return m.select(key, (F.col("margin") > 0).cast("int").alias("prediction"), score.alias("score"))
    depth = model.depth if hasattr(model, "depth") else max(t.depth for t in model.trees)
    nodes = model.nodes() if isinstance(model, SparseTrees) else tree_nodes(stored(model))
    leaves = score_trees(rows, key, nodes, depth, values, places)
    if kind.startswith("GBT") or getattr(model, "kind", "") == "boosted":
        margin = leaves.groupBy(key).agg((2 * F.sum(F.col("tree_weight") * F.col("prediction"))).alias("margin"))
        return margin.select(key, (F.col("margin") > 0).cast("int").alias("prediction"), (1 / (1 + F.exp(-F.col("margin")))).alias("score"))
    votes = leaves.groupBy(key).agg(F.avg(_share("stats")).alias("score"))
    return votes.select(key, (F.col("score") > 0.5).cast("int").alias("prediction"), "score")


# ------------------------------------------------------------------------------ importances

def importance_weights(model) -> DataFrame:
    """``place, weight``: coefficients of a linear model, impurity importances of trees."""
    if hasattr(model, "coefficients"):
        return linear_weights(model).where("place >= 0")
    if isinstance(model, SparseTrees):
        return model.spark.createDataFrame(list(model.importances().items()), "place int, weight double").where("weight <> 0")
    spark = SparkSession.getActiveSession()
    row = spark.createDataFrame([(model.featureImportances.toArray().tolist(),)], "w array<double>")
    return row.select(F.posexplode("w").alias("place", "weight")).where("weight <> 0")


def top_features(weights: DataFrame, names: DataFrame, top: int = 100) -> DataFrame:
    """``rank, name, weight``: the ``top`` features of largest weight (ties by name), by a join of the
    weights with ``place, name`` and a bounded top-k."""
    best = weights.join(names, "place").orderBy(F.desc("weight"), "name").limit(top)
    ranked = best.groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "name"))).alias("all"))
    return (ranked.select(F.posexplode("all").alias("nth", "x"))
            .select((F.col("nth") + 1).alias("rank"), F.col("x.name").alias("name"), (-F.col("x.w")).alias("weight")))
