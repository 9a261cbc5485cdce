"""Splits, stratified folds and label noise, all exact and seeded.

Class-wise numbering never uses a window over the label alone: a label column has two values,
so such a window would put half the table in one task. Exact order (folds) goes through
``keys.dense_positions`` (range-partitioned); seeded random order (noise) through
``keys.random_ranks`` (hash buckets of bounded size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchsmith.operators.joins import bounded_broadcast
from matchsmith.operators.keys import dense_positions, random_ranks

# Noise settings (rate per step, steps) of the label-noise grid.
NOISE_GRID = [(0.01, 1), (0.02, 1), (0.03, 1), (0.04, 1), (0.05, 1), (0.1, 1),
              (0.1, 2), (0.1, 3), (0.1, 4), (0.1, 5)]


def split_by_ids(df: DataFrame, ids: DataFrame, key: str = "pair_id") -> tuple[DataFrame, DataFrame]:
    """(train, valid): rows whose key is not / is in ``ids`` (anti- and semi-join)."""
    i = ids.select(key).distinct()
    return df.join(i, key, "left_anti"), df.join(i, key, "left_semi")


def class_positions(df: DataFrame, label: str, order: list, out: str = "cpos") -> DataFrame:
    """0-based position of each row inside its class under ``order`` (a total order), and the
    class size ``class_n``."""
    pos = dense_positions(df, order, [label], out)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("class_n"))
    return pos.join(bounded_broadcast(sizes), label)


def class_random_ranks(df: DataFrame, label: str, key: str, seed,
                       out: str = "cpos") -> DataFrame:
    """Seeded random rank inside each class (``keys.random_ranks``), and the class size."""
    pos = random_ranks(df, key, seed, [label], out)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("class_n"))
    return pos.join(bounded_broadcast(sizes), label)


def flip_count(n: Column, rate: float, steps: int) -> Column:
    return F.lit(steps) * F.floor(n.cast("double") * F.lit(float(rate)))


def add_label_noise(df: DataFrame, key: str = "pair_id", label: str = "label",
                    pos_rate: float = 0.1, neg_rate: float = 0.1, pos_steps: int = 1,
                    neg_steps: int = 1, seed: int = 42) -> DataFrame:
    """Flip exactly steps x floor(n x rate) labels per class (n = class size), chosen without
    repeats by seeded hash order. Adds ``flipped``."""
    c = class_random_ranks(df, label, key, seed)
    k = F.when(F.col(label) == 1, flip_count(F.col("class_n"), pos_rate, pos_steps)) \
        .otherwise(flip_count(F.col("class_n"), neg_rate, neg_steps))
    flipped = F.col("cpos") < k
    return c.withColumn("flipped", flipped).withColumn(
        label, F.when(F.col("flipped"), 1 - F.col(label)).otherwise(F.col(label))
    ).drop("cpos", "class_n")


def noise_setting_name(rate: float, steps: int) -> str:
    return f"{rate * steps:0.2f}_posnoise_{rate * steps:0.2f}_negnoise"


def label_noise_grid(df: DataFrame, key: str = "pair_id", label: str = "label",
                     grid=NOISE_GRID, seed: int = 42) -> DataFrame:
    """All noised copies in one pass: the class ranking is computed once and each setting is a
    generated row (the grid is a fixed parameter list, not a table)."""
    c = class_random_ranks(df, label, key, seed)
    g = F.array(*[F.struct(F.lit(noise_setting_name(r, s)).alias("setting"),
                           F.lit(float(r)).alias("rate"), F.lit(s).alias("steps"))
                  for r, s in grid])
    e = c.withColumn("g", F.explode(g))
    k = F.col("g.steps") * F.floor(F.col("class_n").cast("double") * F.col("g.rate"))
    flipped = F.col("cpos") < k
    return e.select(F.col("g.setting").alias("setting"), *[x for x in df.columns if x != label],
                    F.when(flipped, 1 - F.col(label)).otherwise(F.col(label)).alias(label),
                    flipped.alias("flipped"))


def stratified_folds(df: DataFrame, label: str, order: list, k: int = 5,
                     out: str = "fold") -> DataFrame:
    """Unshuffled stratified k folds: contiguous blocks per class, the first ``n mod k`` folds
    one row larger (the bucketing of SQL ``ntile``)."""
    c = class_positions(df, label, order)
    n = F.col("class_n")
    q, r = F.floor(n / k), n % k
    big = r * (q + 1)
    fold = F.when(F.col("cpos") < big, F.floor(F.col("cpos") / (q + 1))) \
        .otherwise(r + F.floor((F.col("cpos") - big) / F.greatest(q, F.lit(1))))
    return c.withColumn(out, fold.cast("int")).drop("cpos", "class_n")


def seeded_shuffle(df: DataFrame, key: str, seed) -> DataFrame:
    """Rows in a seeded pseudo-random order (a distributed sort on md5('seed|key'))."""
    from matchsmith.functions.text import seeded_key
    return df.orderBy(seeded_key(seed, key), key)


def seeded_positions(df: DataFrame, key: str, seed, out: str = "position") -> DataFrame:
    """Each row's place (from 0) in the order of ``seeded_shuffle``, without a sort of all rows in one task."""
    from matchsmith.functions.text import seeded_key
    keyed = df.withColumns({"_order": seeded_key(seed, key), "_all": F.lit(0)})
    return dense_positions(keyed, ["_order", key], ["_all"], out).drop("_order", "_all")
