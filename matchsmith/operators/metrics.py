"""Counts and scores: label distribution, class ratio, null profile, per-class precision /
recall / F1, averages, fold averages, sentence statistics. Each is one or two aggregations
with partial (map-side) aggregation; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchsmith.functions.text import word_count


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_ratio(df: DataFrame, label: str = "label") -> DataFrame:
    """round-half-even(negatives / positives), plus both counts."""
    a = df.agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("positives"),
               F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("negatives"))
    return a.withColumn("ratio", F.bround(F.col("negatives") / F.col("positives"), 0)
                        .cast("long"))


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls per column in one pass, as ``column, nulls`` rows."""
    sums = df.agg(*[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(c)
                    for c in df.columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return sums.selectExpr(f"stack({len(df.columns)}, {stack}) AS (column, nulls)") \
        .withColumn("nulls", F.coalesce(F.col("nulls"), F.lit(0)).cast("long"))


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")) \
        .agg(F.count(F.lit(1)).alias("n"))


def _safe_div(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def per_class_metrics(df: DataFrame, truth: str = "truth", pred: str = "pred",
                      extra_keys: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class (0 where the divisor is 0); ``extra_keys``
    computes them per group (for example per fold)."""
    keys = list(extra_keys or [])
    cells = df.groupBy(*keys, F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    # a cell counts for its true class and for its predicted one
    sides = F.explode(F.array(
        F.struct(F.col("t").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(F.lit(0)).alias("tp")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("tp"))))
    m = (cells.select(*keys, sides.alias("s")).groupBy(*keys, F.col("s.cls").alias("cls"))
         .agg(*[F.sum(f"s.{c}").alias(c) for c in ("support", "predicted", "tp")]))
    prec = _safe_div(F.col("tp"), F.col("predicted"))
    rec = _safe_div(F.col("tp"), F.col("support"))
    m = m.withColumn("precision", prec).withColumn("recall", rec)
    f1 = _safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return m.select(*keys, F.col("cls").alias("class"), "precision", "recall",
                    f1.alias("f1"), F.col("support").cast("long").alias("support"),
                    F.col("tp").cast("long").alias("tp"),
                    F.col("predicted").cast("long").alias("predicted"))


def averaged_metrics(per_class: DataFrame) -> DataFrame:
    """Macro, weighted and micro averages of precision / recall / F1, and accuracy."""
    a = per_class.agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support"))
        .alias("weighted_precision"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("weighted_recall"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"))
    # single-label multi-class: micro precision = micro recall = micro F1 = accuracy
    return a.withColumn("micro_f1", F.col("accuracy"))


def prediction_flags(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.withColumn("result", F.when(F.col(pred) == F.col(truth), F.lit("ok"))
                         .otherwise(F.lit("wrong")))


def sentence_stats(df: DataFrame, text: str, group: list[str] | None = None) -> DataFrame:
    wc = word_count(F.col(text))
    return df.groupBy(*(group or [])).agg(F.max(wc).alias("longest"), F.min(wc).alias("shortest"),
                                          F.avg(wc).alias("mean_words"))
