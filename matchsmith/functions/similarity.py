"""Similarity measures as column expressions and as DataFrame operators.

Short texts (titles, names) are compared inside the row with higher-order array functions: no
shuffle. Long texts are compared through exploded token bags: a shuffle by pair key with
partial aggregation, linear in the text length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchsmith.functions.text import split_ws


def _count_in(arr: Column, t: Column) -> Column:
    return F.size(F.filter(arr, lambda x: x == t))


def multiset_intersection_size(a: Column, b: Column) -> Column:
    return F.aggregate(F.array_distinct(a), F.lit(0),
                       lambda acc, t: acc + F.least(_count_in(a, t), _count_in(b, t)))


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Bag Jaccard of two token arrays: sum of min counts over sum of max counts; 1 when both
    are empty, 0 when exactly one is."""
    inter = multiset_intersection_size(a, b)
    union = F.size(a) + F.size(b) - inter
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)) \
        .otherwise(inter.cast("double") / union)


def multiset_jaccard_pairs(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``key, sim``: bag Jaccard of the white-space words of text columns ``a`` and ``b``,
    through exploded bags (for long texts)."""
    base = df.select(key, F.coalesce(F.col(a), F.lit("")).alias("_a"),
                     F.coalesce(F.col(b), F.lit("")).alias("_b"))
    ba = (base.select(key, F.explode(split_ws(F.col("_a"))).alias("tok"))
          .groupBy(key, "tok").agg(F.count(F.lit(1)).alias("ca")))
    bb = (base.select(key, F.explode(split_ws(F.col("_b"))).alias("tok"))
          .groupBy(key, "tok").agg(F.count(F.lit(1)).alias("cb")))
    inter = (ba.join(bb, [key, "tok"]).groupBy(key)
             .agg(F.sum(F.least("ca", "cb")).alias("inter")))
    sizes = base.select(key, F.size(split_ws(F.col("_a"))).alias("na"),
                        F.size(split_ws(F.col("_b"))).alias("nb"))
    j = sizes.join(inter, key, "left").na.fill(0, ["inter"])
    sim = F.when(F.col("na") + F.col("nb") == 0, F.lit(1.0)).otherwise(
        F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter")))
    return j.select(key, sim.alias("sim"))


# ------------------------------------------------------------------------------ token sets

def _padded(s: Column, q: int) -> Column:
    return F.concat(F.lit("#" * (q - 1)), F.coalesce(s, F.lit("")), F.lit("$" * (q - 1)))


def _runs(units: Column, n: Column, q: int, join) -> Column:
    """Every run of ``q`` consecutive elements joined into one: a zip a place, linear in the length."""
    runs = units
    for k in range(1, q):
        runs = F.zip_with(runs, F.slice(units, F.lit(k + 1), F.size(units)), join)
    return F.slice(runs, F.lit(1), n)


def qgrams(s: Column, q: int = 3) -> Column:
    """Character q-grams of a string padded with ``#`` / ``$`` (q-1 each side), in order; [] of an
    empty or null string."""
    padded = _padded(s, q)
    runs = _runs(F.split(padded, ""), F.greatest(F.length(padded) - q + 1, F.lit(1)), q, lambda x, y: F.concat(x, y))
    return F.when(F.length(F.coalesce(s, F.lit(""))) == 0, F.array().cast("array<string>")).otherwise(runs)


# A code point fits 21 bits, so three of them fit a long.
CODE_BITS = 21


def qgram_codes(s: Column, q: int = 3) -> Column:
    """The q-grams of ``qgrams`` as longs, one for one (q up to 3): their code points side by side.
    Sets of longs cost an eighth of sets of strings, and Spark compares them unboxed."""
    if q > 63 // CODE_BITS:
        raise ValueError("a long holds three code points")
    padded = _padded(s, q)
    codes = F.transform(F.split(padded, ""), lambda c: F.ascii(c).cast("long"))
    runs = _runs(codes, F.greatest(F.length(padded) - q + 1, F.lit(1)), q, lambda x, y: F.shiftleft(x, CODE_BITS).bitwiseOR(y))
    return F.when(F.length(F.coalesce(s, F.lit(""))) == 0, F.array().cast("array<bigint>")).otherwise(runs)


def set_jaccard(a: Column, b: Column) -> Column:
    da, db = F.array_distinct(a), F.array_distinct(b)
    inter = F.size(F.array_intersect(da, db))
    union = F.size(F.array_union(da, db))
    return F.when(union == 0, F.lit(None).cast("double")).otherwise(inter / union)


def set_cosine(a: Column, b: Column) -> Column:
    da, db = F.array_distinct(a), F.array_distinct(b)
    inter = F.size(F.array_intersect(da, db))
    den = F.sqrt(F.size(da) * F.size(db))
    return F.when(den == 0, F.lit(None).cast("double")).otherwise(inter / den)


def set_dice(a: Column, b: Column) -> Column:
    da, db = F.array_distinct(a), F.array_distinct(b)
    inter = F.size(F.array_intersect(da, db))
    den = F.size(da) + F.size(db)
    return F.when(den == 0, F.lit(None).cast("double")).otherwise(2 * inter / den)


def set_overlap(a: Column, b: Column) -> Column:
    da, db = F.array_distinct(a), F.array_distinct(b)
    inter = F.size(F.array_intersect(da, db))
    den = F.least(F.size(da), F.size(db))
    return F.when(den == 0, F.lit(None).cast("double")).otherwise(inter / den)


def levenshtein_sim(a: Column, b: Column) -> Column:
    mx = F.greatest(F.length(a), F.length(b))
    return F.when(mx == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / mx)


def abs_norm(a: Column, b: Column) -> Column:
    """1 - |a-b| / max(|a|,|b|); 1 when both are 0."""
    mx = F.greatest(F.abs(a), F.abs(b))
    return F.when(mx == 0, F.lit(1.0)).otherwise(1 - F.abs(a - b) / mx)
