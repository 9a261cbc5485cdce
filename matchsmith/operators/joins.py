"""Join helpers: size-checked broadcast, order-free pair keys, key and foreign-key checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest row count a side may have to be broadcast by ``bounded_broadcast``.
BROADCAST_MAX_ROWS = 2_000_000


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows (checked with a ``limit``
    count, which stops early); otherwise return it unchanged for a shuffle join."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def unordered_key(left: str = "id_left", right: str = "id_right"):
    return [F.least(left, right).alias("_ka"), F.greatest(left, right).alias("_kb")]


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """Key values that are null or occur more than once: ``<key>, n``."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col(key).isNull() | (F.col("n") > 1)))


def fk_violations(df: DataFrame, fk: str, ref: DataFrame, ref_key: str) -> DataFrame:
    """Rows of ``df`` whose foreign key has no match in ``ref`` (anti-join)."""
    r = ref.select(F.col(ref_key).alias(fk)).distinct()
    return df.join(r, fk, "left_anti")
