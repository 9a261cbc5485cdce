"""Reshaping wide pair tables: side prefixes, entity tables, surrogate keys, flattened pairs,
pairs built from two entity tables, name-only projections, line-aligned and name lookups."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchsmith.functions.text import alnum_only, null_word_cleanup
from matchsmith.operators.joins import bounded_broadcast
from matchsmith.operators.keys import dense_positions, surrogate_ids

_SIDE = re.compile(r"^(.*)_(left|right)$")


def suffix_to_table_prefix(df: DataFrame) -> DataFrame:
    """``x_left`` -> ``ltable_x``, ``x_right`` -> ``rtable_x``; other columns unchanged."""
    def rename(c):
        m = _SIDE.match(c)
        if not m:
            return c
        return ("ltable_" if m.group(2) == "left" else "rtable_") + m.group(1)
    return df.toDF(*[rename(c) for c in df.columns])


def _skip_for_matcher(c: str) -> bool:
    return "id_" in c or "_id" in c or c == "label" or "identifier" in c


def flatten_for_matcher(df: DataFrame, key: str = "pair_id", label: str = "label",
                        carry: list[str] | None = None) -> DataFrame:
    """``id, label, left_<attr>..., right_<attr>...`` in input column order; id-like columns
    dropped; values reduced to alphanumeric words. A column must end in _left or _right;
    ``carry`` names columns that are passed on in front as they are."""
    cols = []
    for c in df.columns:
        if _skip_for_matcher(c) or c in (carry or []):
            continue
        m = _SIDE.match(c)
        if not m:
            raise ValueError(f"column {c!r} ends in neither _left nor _right")
        cols.append(alnum_only(F.col(c).cast("string")).alias(f"{m.group(2)}_{m.group(1)}"))
    return df.select(*(carry or []), F.col(key).alias("id"), F.col(label).alias("label"), *cols)


def side_prefix(df: DataFrame, side: str) -> DataFrame:
    """Prefix every column with ``left_`` / ``right_``; ``type`` becomes ``atype``."""
    return df.select(*[F.col(c).alias(f"{side}_{'atype' if c == 'type' else c}")
                       for c in df.columns])


def entity_rows(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """``id, row``: the row of each entity of ``entity_table``."""
    return entity_table(pairs, ["row"], key)


def entity_table(pairs: DataFrame, attrs: list[str], key: str = "pair_id", rows: DataFrame | None = None) -> DataFrame:
    """Stack the left and right offers of a pair table, one row per id, first occurrence kept
    (left side first, then pair order) with a partially aggregated ``min_by``.

    With ``rows`` (``row`` + attributes), the pairs name the offers' rows (``row_left``, ``row_right``)
    in place of their attributes: first occurrences are found among numbers, and only theirs are
    fetched, so no text is copied from pair to pair."""
    held = ["row"] if rows is not None else attrs
    sides = [pairs.select(F.col(f"id_{side}").alias("id"), F.lit(n).alias("_side"), F.col(key).alias("_k"),
                          *[F.col(f"{a}_{side}").alias(a) for a in held]) for n, side in enumerate(("left", "right"))]
    both = sides[0].unionByName(sides[1])
    first = both.groupBy("id").agg(F.min_by(F.struct(*held), F.struct("_side", "_k")).alias("v")).select("id", "v.*")
    return first if rows is None else first.join(rows.select("row", *attrs), "row").select("id", *attrs)


def attach_surrogate_keys(pairs: DataFrame, entities: DataFrame, key: str = "pair_id") -> DataFrame:
    """Dense entity ids (``mag_id``) and pair ids (``_id``), joined back to the pairs with two
    left joins; the row count must not change."""
    ent = surrogate_ids(entities.select("id"), ["id"], "mag_id")
    p = surrogate_ids(pairs.select(key, "id_left", "id_right", "label"), [key], "_id")
    lt = ent.select(F.col("id").alias("id_left"), F.col("mag_id").alias("ltable_mag_id"))
    rt = ent.select(F.col("id").alias("id_right"), F.col("mag_id").alias("rtable_mag_id"))
    return p.join(lt, "id_left", "left").join(rt, "id_right", "left")


def pairs_from_tables(table_a: DataFrame, table_b: DataFrame, pairs: DataFrame,
                      a_key: str, b_key: str, left: str, right: str, label: str,
                      order: list, check: bool = True) -> DataFrame:
    """Wide labelled pairs from two entity tables and an id-pair table: de-duplicated tables
    (last duplicate id wins, by ``_row`` when present), two inner joins, sequential ``id``
    1..n by ``order``; an id missing from a table is an error."""
    def dedup(t, k):
        if "_row" not in t.columns:
            return t
        cols = [c for c in t.columns if c not in (k, "_row")]
        g = t.groupBy(k).agg(F.max_by(F.struct(*cols), F.col("_row")).alias("v"))
        return g.select(k, *[F.col(f"v.{c}").alias(c) for c in cols])
    a, b = dedup(table_a, a_key), dedup(table_b, b_key)
    la = side_prefix(a, "left").withColumnRenamed(f"left_{a_key}", left)
    rb = side_prefix(b, "right").withColumnRenamed(f"right_{b_key}", right)
    extra = [c for c in order if c not in (left, right, label)]
    p = surrogate_ids(pairs.select(left, right, F.col(label).alias("label"), *extra),
                      order, "id", start=1)
    if check:  # an unmatched id fails the query that reads the row; no pass of its own
        for t, name in ((la, "_in_a"), (rb, "_in_b")):
            key = left if t is la else right
            p = p.join(t.withColumn(name, F.lit(True)), key, "left")
        missing = F.raise_error(F.lit("pair table names an id missing from an entity table"))
        j = p.withColumn("id", F.when(F.col("_in_a") & F.col("_in_b"), F.col("id")).otherwise(missing.cast("long")))
    else:
        j = p.join(la, left).join(rb, right)
    return j.select("id", "label", F.col(left).alias(f"left_{a_key}"),
                    *[c for c in la.columns if c != left],
                    F.col(right).alias(f"right_{b_key}"), *[c for c in rb.columns if c != right])


# What each kept column of a pair table is recognised by.
_NAME_MARKS, _WORDS_MARK = ("_name", "_title"), "mtname"


def keep_name_only(df: DataFrame) -> DataFrame:
    """Reduce a wide pair table to names: its first two columns as ``id`` and ``label``, then by
    side the first column that is a name or a title (``<side>_Name``) and, where there is one,
    the last of the category words (``<side>_mtname``). Column names are compared in lower case."""
    def candidates(side: str, marks: tuple[str, ...]) -> list[str]:
        return [c for c in df.columns if f"{side}_" in c.lower() and any(x in c.lower() for x in marks)]

    key, label = df.columns[:2]
    kept = [F.col(key).alias("id"), F.col(label).alias("label")]
    for side in ("left", "right"):
        names = candidates(side, _NAME_MARKS)
        if not names:
            raise ValueError(f"no {side} name or title among {df.columns}")
        words = [c for c in candidates(side, (_WORDS_MARK,)) if c != names[0]]
        kept.append(F.col(names[0]).alias(f"{side}_Name"))
        kept += [F.col(c).alias(f"{side}_mtname") for c in words[-1:]]
    return df.select(*kept)


def line_aligned_join(a: DataFrame, b: DataFrame, a_order: list, b_order: list) -> DataFrame:
    """Row i of ``a`` (by ``a_order``) with row i of ``b``: an equi-join on explicit line
    numbers computed across tasks."""
    la = dense_positions(a, a_order, None, "line_no")
    lb = dense_positions(b, b_order, None, "line_no")
    return la.join(lb, "line_no")


def name_lookup(pairs: DataFrame, names: DataFrame, left: str, right: str,
                name: str = "name", words: str = "words", line: str = "line_no",
                check: bool = True) -> DataFrame:
    """Map left and right names to category words. The last line of a repeated name wins;
    words that start and end with ``null`` become ''; an unknown name is an error."""
    table = names.groupBy(name).agg(F.max_by(words, line).alias("_w"))
    table = table.select(name, null_word_cleanup(F.col("_w")).alias("_w"))
    tb = bounded_broadcast(table)
    out = (pairs.join(tb.select(F.col(name).alias(left), F.col("_w").alias(f"{left}_words")),
                      left, "left")
           .join(tb.select(F.col(name).alias(right), F.col("_w").alias(f"{right}_words")),
                 right, "left"))
    if check:  # an unknown name fails the query that reads the row
        for side in (f"{left}_words", f"{right}_words"):
            out = out.withColumn(side, F.coalesce(F.col(side), F.raise_error(
                F.lit("a name has no category words")).cast("string")))
    return out


def all_names(pairs_by_split: DataFrame, left: str, right: str) -> DataFrame:
    """Left and right names of every pair of every split, repeats kept."""
    return pairs_by_split.select(
        "*", F.posexplode(F.array(F.col(left), F.col(right))).alias("side", "name")
    ).drop(left, right)


def insert_after(df: DataFrame, name: str, value, after: str) -> DataFrame:
    """Add column ``name`` right after column ``after`` (an ordered ``select``)."""
    cols = []
    for c in df.columns:
        if c == name:
            continue
        cols.append(F.col(c))
        if c == after:
            cols.append(value.alias(name))
    return df.select(*cols)
