"""Similarity-feature plan: attribute types from one aggregation, a measure list per type, and
one wide ``select`` that evaluates every planned measure for every pair.

The type cut-offs and measure lists are this library's definition (they follow the usual
entity-matching defaults); they are fixed here in one place and pinned by tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from matchsmith.functions import similarity as S
from matchsmith.functions import tokensets as TS
from matchsmith.functions.text import split_ws, word_count
from matchsmith.session import materialize

# Average-word cut-offs of the string types, and the measures planned per type.
TYPE_CUTOFFS = [(1, "str_eq_1w"), (5, "str_bt_1w_5w"), (10, "str_bt_5w_10w")]
LONG_TYPE = "str_gt_10w"
MEASURES_BY_TYPE = {
    "str_eq_1w": ["lev_dist", "lev_sim", "jaro", "jaro_winkler", "exact_match", "jaccard_qgm3"],
    "str_bt_1w_5w": ["jaccard_qgm3", "cosine_dlm", "jaccard_dlm", "monge_elkan", "lev_dist",
                     "lev_sim", "needleman_wunsch", "smith_waterman"],
    "str_bt_5w_10w": ["jaccard_qgm3", "cosine_dlm", "monge_elkan", "lev_dist", "lev_sim"],
    "str_gt_10w": ["jaccard_qgm3", "cosine_dlm"],
    "numeric": ["exact_match", "abs_norm", "lev_dist", "lev_sim"],
    "boolean": ["exact_match"],
}
ALIGN_MEASURES = {"jaro", "jaro_winkler", "monge_elkan", "needleman_wunsch", "smith_waterman"}


def attribute_types(entities: DataFrame, attrs: list[str], rows: DataFrame | None = None) -> DataFrame:
    """``attribute, avg_words, type`` for each attribute, in one aggregation. With ``rows`` (``row`` +
    attributes), ``entities`` name their rows, and the rows' counts go through the join, not their texts."""
    held = entities if rows is None else rows
    fields = {f.name: f.dataType for f in held.schema.fields}
    counts = []
    for a in attrs:
        v = F.col(a).cast("string")
        counts.append(F.when(F.col(a).isNotNull() & (v != ""), word_count(v)).alias(a))
    counted = entities.select(*counts) if rows is None else entities.select("row").join(rows.select("row", *counts), "row")
    row = counted.agg(*[F.avg(a).alias(a) for a in attrs])
    stack = ", ".join(f"'{a}', `{a}`" for a in attrs)
    t = row.selectExpr(f"stack({len(attrs)}, {stack}) AS (attribute, avg_words)")
    numeric = [a for a in attrs if isinstance(fields[a], TY.NumericType)]
    boolean = [a for a in attrs if isinstance(fields[a], TY.BooleanType)]
    typ = F.when(F.col("attribute").isin(*numeric) if numeric else F.lit(False), "numeric") \
        .when(F.col("attribute").isin(*boolean) if boolean else F.lit(False), "boolean")
    for cut, name in TYPE_CUTOFFS:
        cond = (F.col("avg_words") == cut) if cut == 1 else (F.col("avg_words") <= cut)
        typ = typ.when(cond, name)
    return t.withColumn("type", typ.otherwise(LONG_TYPE))


def feature_plan(types: dict[str, str], include_align: bool = True) -> list[tuple[str, str]]:
    """(attribute, measure) pairs from the attribute types (a small driver-side list)."""
    plan = []
    for attr, typ in types.items():
        for m in MEASURES_BY_TYPE[typ]:
            if include_align or m not in ALIGN_MEASURES:
                plan.append((attr, m))
    return plan


def _words(c: Column) -> Column:
    return split_ws(c)


def measure(name: str, a: Column, b: Column) -> Column:
    """Column expression of one measure; null when either side is null or ''."""
    from matchsmith.functions import align as AL
    if name == "jaccard_qgm3":
        v = S.set_jaccard(S.qgram_codes(a, 3), S.qgram_codes(b, 3))
    elif name == "cosine_dlm":
        v = S.set_cosine(_words(a), _words(b))
    elif name == "jaccard_dlm":
        v = S.set_jaccard(_words(a), _words(b))
    elif name == "lev_dist":
        v = F.levenshtein(a, b).cast("double")
    elif name == "lev_sim":
        v = S.levenshtein_sim(a, b)
    elif name == "exact_match":
        v = (a == b).cast("double")
    elif name == "abs_norm":
        v = S.abs_norm(a.cast("double"), b.cast("double"))
    elif name == "jaro":
        v = AL.jaro_udf(a, b)
    elif name == "jaro_winkler":
        v = AL.jaro_winkler_udf(a, b)
    elif name == "monge_elkan":
        v = AL.monge_elkan_udf(a, b)
    elif name == "needleman_wunsch":
        v = AL.needleman_wunsch_udf(a, b)
    elif name == "smith_waterman":
        v = AL.smith_waterman_udf(a, b)
    else:
        raise ValueError(f"unknown measure {name}")
    missing = a.isNull() | b.isNull() | (a.cast("string") == "") | (b.cast("string") == "")
    return F.when(missing, F.lit(None).cast("double")).otherwise(v)


_SET_TOKENS = {"jaccard_qgm3": "qg3", "cosine_dlm": "ws", "jaccard_dlm": "ws"}


def _set_measure(name: str, inter: Column, a: Column, b: Column) -> Column:
    """A measure of two sets from their intersection's size and their own."""
    if name == "cosine_dlm":
        den = F.sqrt(a * b)
        return F.when(den == 0, F.lit(None).cast("double")).otherwise(inter / den)
    union = a + b - inter
    return F.when(union == 0, F.lit(None).cast("double")).otherwise(inter / union)


def token_sets(entities: DataFrame, plan: list[tuple[str, str]], key: str = "id") -> DataFrame:
    """``id`` (or another key) and, for each set measure of the plan, the entity's token set, packed (``tokensets``): one
    linear pass an entity, whatever number of pairs it is in."""
    sets = sorted({(a, _SET_TOKENS[m]) for a, m in plan if m in _SET_TOKENS})
    return entities.select(key, *[TS.PACK[k](F.col(a).cast("string")).alias(f"_{a}_{k}") for a, k in sets])


def pair_features(pairs: DataFrame, plan: list[tuple[str, str]], keep: list[str],
                  left: str = "{}_left", right: str = "{}_right",
                  entities: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Every planned measure for every pair, named ``<attr>_<measure>``.

    With ``entities`` (``id`` + attributes), token sets of the set measures are built once
    per entity and stored, packed; only ids go with them through the two joins, and the pair's own columns
    meet the few numbers that come out of them. Of an attribute that set measures alone ask for, ``pairs``
    may hold just whether it is there (``<attr>_filled_left``, ``<attr>_filled_right``). With
    ``rows`` (``row`` + attributes), ``entities`` only name their rows (``id, row``): sets are packed where the
    texts lie, and no text goes through a join. Without ``entities``, each pair builds its own sets."""
    sets = sorted({(a, _SET_TOKENS[m]) for a, m in plan if m in _SET_TOKENS})
    if entities is None or not sets:
        cols = [measure(m, F.col(left.format(a)).cast("string"),
                        F.col(right.format(a)).cast("string")).alias(f"{a}_{m}")
                for a, m in plan]
        return pairs.select(*keep, *cols)
    j = pairs.select("id_left", "id_right").distinct()
    key = "id" if rows is None else "row"
    ent = materialize(token_sets(entities if rows is None else rows, plan, key))
    for side in ("left", "right"):
        if rows is not None:
            j = j.join(entities.select(F.col("id").alias(f"id_{side}"), F.col("row").alias(f"row_{side}")), f"id_{side}")
    for side in ("left", "right"):
        j = j.join(ent.select(*[F.col(c).alias(f"{c}_{side}" if c == key else f"{c}_{side[0]}") for c in ent.columns]), f"{key}_{side}")
    of_sets = [(a, m) for a, m in plan if m in _SET_TOKENS]
    common = j.select("id_left", "id_right", *[x for a, k in sets for x in (
        F.col(f"_{a}_{k}_l.n").alias(f"_{a}_{k}_nl"), F.col(f"_{a}_{k}_r.n").alias(f"_{a}_{k}_nr"),
        TS.COMMON[k](F.col(f"_{a}_{k}_l"), F.col(f"_{a}_{k}_r")).alias(f"_{a}_{k}_n"))])
    shared = common.select("id_left", "id_right", *[
        _set_measure(m, *[F.col(f"_{a}_{_SET_TOKENS[m]}_{x}") for x in ("n", "nl", "nr")]).alias(f"_{a}_{m}") for a, m in of_sets])
    cols = []
    for a, m in plan:
        names = [x.format(a) for x in (left, right)]
        if m not in _SET_TOKENS:
            cols.append(measure(m, *[F.col(x).cast("string") for x in names]).alias(f"{a}_{m}"))
            continue
        if names[0] in pairs.columns:
            there = [F.coalesce(F.col(x).cast("string") != "", F.lit(False)) for x in names]
        else:
            there = [F.col(x.format(f"{a}_filled")) for x in (left, right)]
        cols.append(F.when(there[0] & there[1], F.col(f"_{a}_{m}")).alias(f"{a}_{m}"))
    return pairs.join(shared, ["id_left", "id_right"], "left").select(*keep, *cols)
