"""Matchers: feature assembly, class weights, and naive Bayes as parameter tables.

Naive Bayes, Bernoulli over words and Gaussian over measures, is fitted by aggregations into parameter
tables and scored by joins with them. The other learners are Spark ML's (``experiments``); their
fitted models become tables in ``model_tables``.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchsmith.operators.joins import bounded_broadcast


def assemble(df: DataFrame, feature_cols: list[str], out: str = "features") -> DataFrame:
    """Fill missing measures with 0, then one vector column (invalid values are errors)."""
    filled = df.na.fill(0.0, subset=feature_cols)
    va = VectorAssembler(inputCols=feature_cols, outputCol=out, handleInvalid="error")
    return va.transform(filled).withColumn("label", F.col("label").cast("double"))


def balanced_weights(df: DataFrame, train, label: str = "label", out: str = "weight") -> DataFrame:
    """Weight n / (classes x rows of the class) over the rows of ``train``, so that both classes
    count alike in a fit."""
    n = df.where(train).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a class
    total, weight = sum(r["n"] for r in n), F.lit(1.0)
    for r in n:
        weight = F.when(F.col(label) == r[label], F.lit(total / (len(n) * r["n"]))).otherwise(weight)
    return df.withColumn(out, weight)


def score_column(predictions: DataFrame) -> F.Column:
    """Probability of class 1 where the model has one, else the raw margin of class 1."""
    if "probability" in predictions.columns:
        return vector_to_array("probability").getItem(1)
    return vector_to_array("rawPrediction").getItem(1)


# ------------------------------------------------------------------------------ naive Bayes

def bernoulli_nb_params(df: DataFrame, idx_col: str, vocab_size_df: DataFrame,
                        alpha: float = 1.0) -> DataFrame:
    """``label, feature, log_prob`` = log((N_cj + a) / (N_c + 2a)) for every class and
    vocabulary index, and ``label, feature=-1, log_prob`` = class log prior. Counts are one
    explode + aggregate; classes are the binary labels."""
    n_c = df.groupBy("label").agg(F.count(F.lit(1)).alias("n_c"))
    n = df.count()
    counts = (df.select("label", F.explode(idx_col).alias("feature"))
              .groupBy("label", "feature").agg(F.count(F.lit(1)).alias("n_cj")))
    grid = vocab_size_df.select(F.col("idx").alias("feature"),
                                F.explode(F.array(F.lit(0), F.lit(1))).alias("label"))
    t = (grid.join(n_c, "label").join(counts, ["label", "feature"], "left")
         .na.fill(0, ["n_cj"]))
    lp = F.log((F.col("n_cj") + alpha) / (F.col("n_c") + 2 * alpha))
    priors = n_c.select("label", F.lit(-1).cast("long").alias("feature"),
                        F.log(F.col("n_c") / F.lit(n)).alias("log_prob"))
    return t.select("label", "feature", lp.alias("log_prob")).unionByName(priors)


def bernoulli_nb_predict(df: DataFrame, key: str, idx_col: str, params: DataFrame) -> DataFrame:
    """Score Bernoulli naive Bayes from its parameter table, distributed:
    score_c = log prior_c + sum_j log(1 - theta_cj) + sum_{j in x} (log theta_cj - log(1 - theta_cj)).
    One explode of each row's present features and a join on the feature index; no vocabulary
    or model object on the driver. Adds ``prediction`` and ``score`` (probability of class 1)."""
    theta = params.where(F.col("feature") >= 0)
    prior = params.where(F.col("feature") < 0).select("label", F.col("log_prob").alias("prior"))
    log_not = F.log1p(-F.exp(F.col("log_prob")))
    base = theta.groupBy("label").agg(F.sum(log_not).alias("absent")).join(prior, "label") \
        .select("label", (F.col("prior") + F.col("absent")).alias("base"))
    delta = theta.select("label", "feature", (F.col("log_prob") - log_not).alias("delta"))
    present = (df.select(key, F.explode(idx_col).alias("feature"))
               .join(delta, "feature").groupBy(key, "label")
               .agg(F.sum("delta").alias("gain")))
    rows = df.select(key, F.explode(F.array(F.lit(0), F.lit(1))).alias("label"))
    sc = (rows.join(base, "label").join(present, [key, "label"], "left")
          .withColumn("s", F.col("base") + F.coalesce("gain", F.lit(0.0))))
    w = sc.groupBy(key).agg(F.max(F.when(F.col("label") == 0, F.col("s"))).alias("s0"),
                            F.max(F.when(F.col("label") == 1, F.col("s"))).alias("s1"))
    out = w.select(key, F.when(F.col("s1") > F.col("s0"), 1).otherwise(0).alias("prediction"),
                   (1 / (1 + F.exp(F.col("s0") - F.col("s1")))).alias("score"))
    return df.join(out, key)


def gaussian_nb_params(df: DataFrame, features: list[str]) -> DataFrame:
    """``label, feature, mean, var`` (population variance) per class and feature, one
    aggregation after unpivoting."""
    filled = df.na.fill(0.0, subset=features)
    stack = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in features)
    long = filled.selectExpr("label", f"stack({len(features)}, {stack}) AS (feature, value)")
    return long.groupBy("label", "feature").agg(F.avg("value").alias("mean"),
                                                F.var_pop("value").alias("var"))


# Share of the largest variance of any feature that is added to all variances, so that a constant
# feature of a class has a density (the usual smoothing of Gaussian naive Bayes).
VAR_SMOOTHING = 1e-9


def gaussian_nb_predict(df: DataFrame, key: str, features: list[str], params: DataFrame, train: DataFrame) -> DataFrame:
    """Score Gaussian naive Bayes from its parameter table: the log densities of a row's unpivoted
    features, summed by class, and the class's log share of the training rows. Missing features
    count as 0. Adds ``prediction`` and ``score`` (probability of class 1)."""
    everywhere = train.na.fill(0.0, subset=features).agg(F.greatest(*[F.var_pop(c) for c in features], F.lit(0.0)).alias("v"))
    smooth = float(everywhere.head()["v"] or 0.0) * VAR_SMOOTHING  # one number
    prior = train.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    prior = prior.join(prior.agg(F.sum("n").alias("total")).withColumn("one", F.lit(1)), F.col("one") == F.lit(1)) \
        .select("label", F.log(F.col("n") / F.col("total")).alias("prior"))
    stack = ", ".join(f"'{c}', coalesce(CAST(`{c}` AS DOUBLE), 0.0)" for c in features)
    long = df.selectExpr(key, f"stack({len(features)}, {stack}) AS (feature, value)")
    var = F.col("var") + F.lit(smooth)
    log_density = -0.5 * F.log(2 * F.lit(math.pi) * var) - (F.col("value") - F.col("mean")) ** 2 / (2 * var)
    by_class = (long.join(bounded_broadcast(params), "feature").groupBy(key, "label").agg(F.sum(log_density).alias("s"))
                .join(F.broadcast(prior), "label").withColumn("s", F.col("s") + F.col("prior")))  # a row a class
    w = by_class.groupBy(key).agg(F.max(F.when(F.col("label") == 0, F.col("s"))).alias("s0"),
                                  F.max(F.when(F.col("label") == 1, F.col("s"))).alias("s1"))
    return df.join(w.select(key, F.when(F.col("s1") > F.col("s0"), 1).otherwise(0).alias("prediction"),
                            (1 / (1 + F.exp(F.col("s0") - F.col("s1")))).alias("score")), key)


def bernoulli_nb_importance(params: DataFrame) -> DataFrame:
    """``feature, weight``: how much more likely class 1 holds a word than class 0, in logs."""
    by_class = params.where("feature >= 0").groupBy("feature").agg(
        F.max(F.when(F.col("label") == 1, F.col("log_prob"))).alias("p1"), F.max(F.when(F.col("label") == 0, F.col("log_prob"))).alias("p0"))
    return by_class.select("feature", (F.col("p1") - F.col("p0")).alias("weight"))


def spark_nb(model_type: str = "bernoulli", smoothing: float = 1.0) -> NaiveBayes:
    return NaiveBayes(modelType=model_type, smoothing=smoothing)
