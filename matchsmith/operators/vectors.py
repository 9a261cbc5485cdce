"""Word-occurrence vectorising: vocabulary per feature combination (document frequency >= 2
over distinct entities), binary word vectors, and word co-occurrence of a pair.

Vectors are sorted ``array<long>`` word indices (a sparse binary vector); naive Bayes over them is
fitted and scored from parameter tables (``plans.models``), so no vocabulary is held on the driver. Everything is explode / aggregate / join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchsmith.functions.text import combine, vocab_tokens
from matchsmith.operators.keys import dense_positions


def combo_texts(entities: DataFrame, combos: dict[str, list[str]]) -> DataFrame:
    """``combo, id, text``: one row per entity and feature combination."""
    arr = F.array(*[F.struct(F.lit(name).alias("combo"),
                             combine([F.col(c) for c in cols]).alias("text"))
                    for name, cols in combos.items()])
    return entities.select("id", F.explode(arr).alias("x")).select("x.combo", "id", "x.text")


def doc_words(entities: DataFrame, combos: dict[str, list[str]]) -> DataFrame:
    """``id, at, word``: distinct words of each entity, once for all combinations. Each combination adds
    attributes to the one before, and no word spans two attributes: a combination holds the words whose
    ``at``, the place of the first combination with them, isn't after its own."""
    order = [set(c) for c in combos.values()]
    if any(not a <= b for a, b in zip(order, order[1:])):
        raise ValueError("a combination must hold the attributes of the one before")
    words = entities.select("id", *[F.array_distinct(vocab_tokens(combine(
        [F.col(c) for c in cols if at == 0 or c not in order[at - 1]]))).alias(f"_w{at}") for at, cols in enumerate(combos.values())])
    placed = lambda words, at: F.transform(words, lambda w: F.struct(F.lit(at).alias("at"), w.alias("word")))
    parts = []
    for at in range(len(order)):
        fresh = F.col(f"_w{at}")
        for earlier in range(at):
            fresh = F.array_except(fresh, F.col(f"_w{earlier}"))
        parts.append(placed(fresh, at))
    return words.select("id", F.explode(F.concat(*parts)).alias("x")).select("id", "x.at", "x.word")


def vocabulary(entities: DataFrame, combos: dict[str, list[str]], min_df: int = 2) -> DataFrame:
    """``combo, word, df, idx``: words in at least ``min_df`` documents, indexed in sorted
    order (0-based) per combination."""
    dfreq = doc_words(entities, combos).groupBy("word").agg(*[
        F.count(F.when(F.col("at") <= n, 1)).alias(name) for n, name in enumerate(combos)])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("combo"), F.col(name).alias("df")) for name in combos]))
    kept = dfreq.select("word", each.alias("x")).select("x.combo", "word", "x.df").where(F.col("df") >= min_df)
    return dense_positions(kept, ["word"], ["combo"], "idx")


def word_vectors(entities: DataFrame, combos: dict[str, list[str]], vocab: DataFrame) -> DataFrame:
    """``combo, id, idx``: sorted vocabulary indices of each document (missing words dropped;
    documents without a known word get []). A word's indices in all combinations go through the
    joins as one row."""
    wide = vocab.groupBy("word").agg(*[F.max(F.when(F.col("combo") == name, F.col("idx"))).alias(name) for name in combos])
    w = doc_words(entities, combos).join(wide, "word").select(
        "id", *[F.when(F.col("at") <= n, F.col(name)).alias(name) for n, name in enumerate(combos)])
    v = w.groupBy("id").agg(*[F.array_sort(F.collect_list(name)).alias(name) for name in combos])
    none = F.array().cast("array<bigint>")
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("combo"), F.coalesce(F.col(name), none).alias("idx")) for name in combos]))
    return entities.select("id").join(v, "id", "left").select("id", each.alias("x")).select("x.combo", "id", "x.idx")


def cooccurrence(pairs: DataFrame, vectors: DataFrame, left: str = "id_left",
                 right: str = "id_right") -> DataFrame:
    """Per pair and combination: the vocabulary words both offers contain (element-wise
    product of two binary vectors), as sorted indices ``shared``. An entity's vectors of all
    combinations go through the joins as one row, and only ids go with them."""
    combos = vectors.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("combo", "idx"))).alias("_v"))  # a few an entity
    ids = pairs.select(left, right).distinct()
    j = (ids.join(combos.select(F.col("id").alias(left), F.col("_v").alias("_l")), left)
         .join(combos.select(F.col("id").alias(right), F.col("_v").alias("_r")), right))
    each = j.select(left, right, "_r", F.explode("_l").alias("combo", "_i"))
    shared = each.where(F.map_contains_key("_r", F.col("combo"))).select(
        left, right, "combo", F.array_sort(F.array_intersect("_i", F.element_at("_r", F.col("combo")))).alias("shared"))
    return pairs.join(shared, [left, right])


def vector_abs_diff(a: Column, b: Column) -> Column:
    """Element-wise |a - b| of two numeric arrays (in double)."""
    return F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
