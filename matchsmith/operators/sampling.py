"""Seeded, capped pair sampling (W6) in one round, without listing candidate pairs.

A cluster of m offers has m(m-1)/2 candidate match pairs and two clusters m1*m2 non-match
pairs. Neither is materialised. Offers are ranked in their cluster, those without a gold title
("clean") before the others, so that the clean pairs and the bad pairs (an offer with a gold
title) of a group are two index ranges. Gold pairs are taken out of the ranges by their sorted
indices. Each range is drawn in a seeded order of its own, a full-cycle walk over its indices:

    index(t) = (stride * t + offset) mod size,   t = 0, 1, 2, ...

with a prime stride larger than any size (chosen, like the offset, by hash), so every pair
comes exactly once and with the same chance at every t. The two orders are merged in proportion
to their sizes; ``pos`` is the place in the merged order. A sample of S pairs with at most
``cap`` bad ones needs at most the first S clean and the first ``cap`` bad draws: the work
follows the sample, however large the group and however rare its clean pairs are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchsmith.functions.text import seeded_key

# Primes over 2^60, the strides of the walks. Sizes stay below 2^50, draws below 2^12
# times that, so products fit a long.
STRIDES = (1152921504606847009, 1152921504606847067, 1152921504606847081, 1152921504606847123)


def capped_sample(cands: DataFrame, group: list[str], pos: str = "pos", bad: str = "bad",
                  size: str = "S", cap: str = "cap", fallback: str = "fallback") -> DataFrame:
    """Keep, per group, the first ``size`` candidates by ``pos`` after dropping bad candidates
    beyond the first ``cap`` bad ones; groups flagged ``fallback`` keep their first candidate.

    This is the one-pass form of draw / drop surplus bad pairs / refill: the kept set has the
    same distribution as the iterative procedure for a uniformly random ``pos`` order.
    """
    w_bad = Window.partitionBy(*group, bad).orderBy(pos)
    c = cands.withColumn("_rb", F.row_number().over(w_bad))
    normal = c.where(~F.col(fallback) & (~F.col(bad) | (F.col("_rb") <= F.col(cap))))
    normal = normal.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(pos)))
    normal = normal.where(F.col("_k") <= F.col(size)).drop("_k")
    fb = c.where(F.col(fallback))
    fb = fb.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(pos)))
    fb = fb.where(F.col("_k") == 1).drop("_k")
    return normal.unionByName(fb).drop("_rb")


def _div(a: Column, b) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("long"))


def _half_product(n: Column) -> Column:
    return _div(n * (n - 1), 2)


def _hash60(*parts) -> Column:
    """The leading 60 bits of a seeded md5."""
    return F.conv(F.substring(seeded_key(*parts), 1, 15), 16, 10).cast("long")


def walk(size: Column, t: Column, h: Column) -> Column:
    """Index of draw ``t`` of a range of ``size`` under the hash ``h``."""
    stride = F.element_at(F.array(*[F.lit(x) for x in STRIDES]), (F.pmod(h, F.lit(len(STRIDES))) + 1).cast("int"))
    return F.pmod(F.pmod(stride, size) * t + F.pmod(_div(h, len(STRIDES)), size), size)


def merged_position(t: Column, own: Column, other: Column, after_ties: Column) -> Column:
    """Place of draw ``t`` of ``own`` draws among ``other`` draws when both are spread evenly: t
    plus the number of the others' draws b with (2b+1)/other below (2t+1)/own (or equal, where
    ``after_ties``)."""
    ours, step = (2 * t + 1) * other, 2 * own
    # others' draws at or under the mark: (2b + 1) * own <= ours, less one unit without ties
    mark = F.when(after_ties, ours).otherwise(ours - 1)
    before = F.when(mark >= own, _div(mark - own, step) + 1).otherwise(F.lit(0).cast("long"))
    return t + F.least(before, other)


def draws(groups: DataFrame, seed, keys: list[str], clean: str = "n_clean", bad: str = "n_bad",
          size: str = "S", cap: str = "cap") -> DataFrame:
    """The draws a capped sample can need of each group (columns of ``groups`` are kept): ``bad``
    says of which range, ``idx`` which pair of it, ``pos`` the place in the merged order."""
    kinds = F.explode(F.array(
        F.struct(F.lit(False).alias("bad"), F.col(clean).alias("n"), F.col(bad).alias("o"), F.least(clean, size).alias("take")),
        F.struct(F.lit(True).alias("bad"), F.col(bad).alias("n"), F.col(clean).alias("o"),
                 F.least(F.col(bad), F.greatest(F.col(cap), F.lit(1))).alias("take"))))
    k = groups.withColumn("_k", kinds).where("_k.take > 0")
    k = k.withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k.take") - 1)))
    h = _hash60(seed, *keys, F.col("_k.bad").cast("string"))
    k = k.withColumns({"bad": F.col("_k.bad"), "idx": walk(F.col("_k.n"), F.col("_t"), h),
                       "pos": merged_position(F.col("_t"), F.col("_k.n"), F.col("_k.o"), F.col("_k.bad"))})
    return k.drop("_k", "_t")


def past_gold(idx: Column, gold: Column) -> Column:
    """Index in the whole range of the ``idx``-th pair that isn't in the sorted array ``gold``."""
    return idx + F.size(F.filter(gold, lambda g, i: g - i <= idx))


def pair_of_index(idx: Column) -> tuple[Column, Column]:
    """Ranks (i, j), i < j, of the ``idx``-th pair of a cluster, by j and then i."""
    j = F.floor((F.sqrt(8.0 * idx + 1.0) + 1) / 2)
    j = j - F.when(_half_product(j) > idx, 1).otherwise(0)  # the root is a double: mend its last place
    j = j + F.when(_half_product(j + 1) <= idx, 1).otherwise(0)
    return idx - _half_product(j), j


def index_of_pair(a: Column, b: Column) -> Column:
    """Inverse of ``pair_of_index`` for two different ranks in either order."""
    return _half_product(F.greatest(a, b)) + F.least(a, b)


def cross_of_index(idx: Column, bad: Column, m_x: Column, g_o: Column, g_x: Column) -> tuple[Column, Column]:
    """Ranks (owner, other) of a pair across two clusters: clean pairs row by row; bad ones the
    clean owners with the others' bad offers, then the bad owners with all."""
    bad_x = F.greatest(m_x - g_x, F.lit(1))
    first = g_o * (m_x - g_x)
    later = idx - first
    clean_i, clean_j = _div(idx, F.greatest(g_x, F.lit(1))), F.pmod(idx, F.greatest(g_x, F.lit(1)))
    i = F.when(~bad, clean_i).when(idx < first, _div(idx, bad_x)).otherwise(g_o + _div(later, m_x))
    j = F.when(~bad, clean_j).when(idx < first, g_x + F.pmod(idx, bad_x)).otherwise(F.pmod(later, m_x))
    return i, j


def index_of_cross(i: Column, j: Column, m_x: Column, g_o: Column, g_x: Column) -> Column:
    """Inverse of ``cross_of_index`` within the pair's own range."""
    clean = (i < g_o) & (j < g_x)
    return F.when(clean, i * g_x + j).when(i < g_o, i * (m_x - g_x) + j - g_x) \
        .otherwise(g_o * (m_x - g_x) + (i - g_o) * m_x + j)


def fetch_pair(drawn: DataFrame, ranked: DataFrame, left: str, right: str) -> DataFrame:
    """Ids of ranks ``i`` of cluster ``left`` and ``j`` of cluster ``right`` (``id_i``, ``id_j``): two
    joins on unique (cluster, rank) keys."""
    for rank, cluster in (("i", left), ("j", right)):
        side = ranked.select(F.col("cluster_id").alias("_c"), F.col("rank").alias("_r"), F.col("id").alias(f"id_{rank}"))
        drawn = drawn.join(side, (F.col(cluster) == F.col("_c")) & (F.col(rank) == F.col("_r"))).drop("_c", "_r")
    return drawn


def exclude_pairs(cands: DataFrame, excluded: DataFrame) -> DataFrame:
    """Drop candidates present in ``excluded`` (id_left, id_right) in either order."""
    ex = excluded.select(F.least("id_left", "id_right").alias("_a"),
                         F.greatest("id_left", "id_right").alias("_b")).distinct()
    c = cands.withColumn("_a", F.least("id_left", "id_right")) \
             .withColumn("_b", F.greatest("id_left", "id_right"))
    return c.join(ex, ["_a", "_b"], "left_anti").drop("_a", "_b")
