"""Dense positions and surrogate keys without a single-task window.

``row_number()`` over ``Window.partitionBy(group)`` sorts a whole group inside one task, and
without ``partitionBy`` it moves the whole table into one task. When one group may hold a third
of all rows neither survives. ``dense_positions`` instead range-partitions on (group, order), so
a hot group is cut across many tasks, numbers rows inside each task, and adds per-task offsets
computed from a small (task x group) count table. Same numbers as ``row_number() - 1``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchsmith.session import materialize

_LOW_BITS = (1 << 33) - 1


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def dense_positions(df: DataFrame, order_by: list, group_by: list[str] | None = None,
                    out: str = "pos", num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of each row within its group under ``order_by``.

    ``order_by`` must be a total order inside each group (end it with a unique key), so the
    numbering is the same whatever the partitioning.
    """
    group_by = list(group_by or [])
    order_cols = _cols(order_by)
    tmp_order = [f"_o{i}" for i in range(len(order_cols))]
    base = df.select("*", *[c.alias(t) for c, t in zip(order_cols, tmp_order)])
    sort_keys = group_by + tmp_order
    # without an explicit count AQE may merge adjacent ranges (order is kept); the numbering
    # below runs on whatever partitions result
    ranged = (base.repartitionByRange(num_partitions, *sort_keys) if num_partitions
              else base.repartitionByRange(*sort_keys))
    tagged = (ranged.sortWithinPartitions(*sort_keys)
              .withColumn("_mid", F.monotonically_increasing_id())
              .withColumn("_pid", F.shiftrightunsigned("_mid", 33))
              .withColumn("_lpos", F.col("_mid").bitwiseAND(F.lit(_LOW_BITS))))
    # Both the per-task counts and the numbering must see the very same partitions. Range
    # bounds are sampled, and an input coming out of a shuffle has no fixed row order, so two
    # evaluations could cut differently: materialise once (parquet in the checkpoint folder;
    # the count branch then reads only the group and task columns).
    tagged = materialize(tagged)
    stats = tagged.groupBy(*group_by, "_pid").agg(
        F.min("_lpos").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    w = (Window.partitionBy(*group_by) if group_by else Window.partitionBy(F.lit(0)))
    w = w.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per (task, group): at most tasks + groups rows
    stats = stats.withColumn("_start", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    res = (tagged.join(stats.select(*group_by, "_pid", "_first", "_start"), [*group_by, "_pid"])
           .withColumn(out, F.col("_start") + F.col("_lpos") - F.col("_first")))
    return res.drop("_mid", "_pid", "_lpos", "_first", "_start", *tmp_order)


def surrogate_ids(df: DataFrame, order_by: list, out: str = "sid", start: int = 0,
                  num_partitions: int | None = None) -> DataFrame:
    """Dense ids ``start .. start+n-1`` over a total order, computed across many tasks."""
    res = dense_positions(df, order_by, None, out, num_partitions)
    return res.withColumn(out, F.col(out) + F.lit(start)) if start else res


def next_in_order(df: DataFrame, key: str, order_by: list, group_by: list[str] | None = None,
                  out: str = "nxt") -> DataFrame:
    """Pair every row's ``key`` with the ``key`` of the following row in its group
    (``lead(key)``), as an equi-join on (group, position + 1)."""
    group_by = list(group_by or [])
    pos = dense_positions(df.select(*group_by, key, *[c for c in order_by if isinstance(c, str)
                                                      and c not in (key, *group_by)]),
                          order_by, group_by, "_p")
    nxt = pos.select(*group_by, (F.col("_p") - 1).alias("_p"), F.col(key).alias(out))
    return pos.join(nxt, [*group_by, "_p"], "left").drop("_p")


# Rows per bucket of a seeded random ranking: a group larger than this is split into
# ceil(size / RANK_CHUNK) hash buckets, each ranked by one task.
RANK_CHUNK = 1_000_000


def random_ranks(df: DataFrame, key: str, seed, group_by: list[str] | None = None,
                 out: str = "rank", chunk: int = RANK_CHUNK) -> DataFrame:
    """Seeded random permutation rank 0..n-1 of the rows of each group, fully declarative.

    The order is (md5('seed|key'), key) at any size. A group of n rows is cut into
    k = ceil(n / chunk) buckets by the leading 32 bits of the md5, ``floor(bits * k / 2^32)``,
    which rises with the md5: ``chunk`` only says how many rows one task ranks. Bucket offsets
    come from a (group x bucket) count table. Deterministic for any partitioning, so no
    checkpoint is needed."""
    from matchsmith.functions.text import seeded_key
    g = list(group_by or [])
    gcols = g or [F.lit(0).alias("_g0")]
    gnames = g or ["_g0"]
    base = df.select("*", *([] if g else [F.lit(0).alias("_g0")]))
    h = seeded_key(seed, key)
    sizes = base.groupBy(*gnames).agg(F.count(F.lit(1)).alias("_n"))
    d = base.join(sizes, gnames).withColumn("_h", h)
    k = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("_n") / F.lit(chunk)))
    d = d.withColumn("_b", F.shiftright(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * k, 32))
    counts = d.groupBy(*gnames, "_b").agg(F.count(F.lit(1)).alias("_c"))
    wo = Window.partitionBy(*gnames).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_off", F.coalesce(F.sum("_c").over(wo), F.lit(0)))
    d = d.join(counts.select(*gnames, "_b", "_off"), [*gnames, "_b"])
    w = Window.partitionBy(*gnames, "_b").orderBy("_h", key)
    d = d.withColumn(out, F.row_number().over(w) - 1 + F.col("_off"))
    return d.drop("_n", "_h", "_b", "_off", *([] if g else ["_g0"]))
