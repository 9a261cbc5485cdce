"""Label encodings as column expressions: sorted label index, one-hot, arg-max, match map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchsmith.operators.joins import bounded_broadcast
from matchsmith.operators.keys import dense_positions


def index_labels(df: DataFrame, label: str, out: str = "label_idx",
                 one_hot: str | None = "one_hot") -> DataFrame:
    """Labels to 0..k-1 in sorted order (the distinct labels are few: a partially aggregated
    ``distinct``, numbered and broadcast after a size check), plus a one-hot string."""
    labels = dense_positions(df.select(label).distinct(), [label], None, out)
    k = labels.count()
    res = df.join(bounded_broadcast(labels), label)
    if one_hot:
        res = res.withColumn(one_hot, F.array_join(F.transform(
            F.sequence(F.lit(0), F.lit(k - 1)),
            lambda i: F.when(i == F.col(out), F.lit("1")).otherwise(F.lit("0"))), ","))
    return res


def one_hot_array(idx: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == idx).cast("int"))


def argmax(arr: Column) -> Column:
    """0-based position of the largest value (first on ties)."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("long")


def match_label_map(label: Column, no_match="0", match="1") -> Column:
    """No-match label to 0, match label to 1, anything else to 2."""
    s = label.cast("string")
    return F.when(s == no_match, 0).when(s == match, 1).otherwise(2)
