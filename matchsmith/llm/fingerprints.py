"""I-Match fingerprints over randomised lexicon subsets.

The lexicon holds the terms (lower-cased words without outer punctuation) whose inverse document
frequency lies in a band: neither the words of every text nor one-off typos. A text's distinct
lexicon terms are sorted, and hashed in that order for the whole lexicon and for ``SUBSETS``
random subsets of it at each of several sampling rates. An edit changes only the hashes of
subsets that hold a changed term; sparse subsets survive large edits, dense ones tell small
edits apart. One more component hashes all of a text's terms, so texts without lexicon terms have
fingerprints that tell them apart too.

Lexicon bound: terms in at least a share ``f`` of the documents number at most (mean distinct
terms a document) / f. ``f`` is ``RAREST`` or more, as much as keeps that bound to
``MAX_LEXICON``, so the broadcast never exceeds 8 bytes x ``MAX_LEXICON`` at any corpus size.

Equal texts have equal fingerprints; null and empty texts (and texts without words) share the
fingerprint of no terms, and are alike (1.0). Null keys come first in key order; rows with
equal keys are ordered by text. Empty tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

import string
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchsmith.llm.common import SLICE_BYTES, map_texts, texts_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COMMONEST, RAREST = 0.25, 1e-4
MAX_LEXICON = 4_000_000
SUBSETS = 16
RATES = (1 / 4, 1 / 16, 1 / 64, 1 / 256, 1 / 1024, 1 / 4096)
# The whole lexicon, its subsets by rate, and all terms.
COMPONENTS = 2 + SUBSETS * len(RATES)
# A rate counts for likeness if so many of its subsets hold a term of either text.
LEAST_HELD = 6

_TERM_KEY = "i-match-term-key"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct_terms(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, term hash) of the distinct terms of each row, sorted."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts_of(col)))
    words = lists.values.dictionary_encode()
    terms = pc.utf8_trim(words.dictionary, string.punctuation)
    hashes = pd.util.hash_array(terms.to_numpy(zero_copy_only=False), hash_key=_TERM_KEY, categorize=False) \
        if len(terms) else np.empty(0, np.uint64)
    held = pc.not_equal(terms, "").to_numpy(zero_copy_only=False).astype(bool)
    codes = words.indices.to_numpy()
    rows = np.repeat(np.arange(len(col)), np.diff(lists.offsets.to_numpy()))
    inside = held[codes] if len(codes) else np.empty(0, bool)
    ranked, code_of = np.unique(hashes, return_inverse=True)
    pairs = np.unique((rows[inside].astype(np.int64) << 32) | code_of[codes[inside]])
    return pairs >> 32, ranked[pairs & 0xFFFFFFFF]


def term_counts(df: DataFrame, text: str) -> DataFrame:
    """``term`` (hash), ``n``: in how many rows each term stands. Slices count before the shuffle."""
    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        terms, n = np.unique(distinct_terms(part.column(0))[1], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], ["term", "n"])

    return map_texts(df, [text], text, "term long, n long", step).groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(df: DataFrame, text: str = "text", commonest: float = COMMONEST, rarest: float = RAREST) -> np.ndarray:
    """Sorted hashes of the terms in the band."""
    rows = df.count()
    counts = term_counts(df, text).persist()
    pairs = counts.agg(F.sum("n")).head()[0] or 0
    least = max(rarest * rows, pairs / MAX_LEXICON, 2)
    chosen = counts.filter((F.col("n") >= least) & (F.col("n") <= max(commonest * rows, least))).select("term")
    out = np.sort(chosen.toPandas()["term"].to_numpy(np.int64).view(np.uint64))  # at most MAX_LEXICON
    counts.unpersist()
    return out


def components(rows: np.ndarray, terms: np.ndarray, n: int, lex: np.ndarray) -> np.ndarray:
    """n x COMPONENTS array of hashes; 0 where no term of the row is in the subset."""
    at = np.minimum(np.searchsorted(lex, terms), max(len(lex) - 1, 0))
    known = lex[at] == terms if len(lex) else np.zeros(len(terms), bool)
    value = _mix(terms)
    out = np.zeros((n, COMPONENTS), np.uint32)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(np.bincount(rows, minlength=1).max()) + 1 if len(rows) else 1, _ODD, np.uint64))
        for c in range(COMPONENTS):
            if c == COMPONENTS - 1:
                r, v = rows, value
            elif c:
                rate = RATES[(c - 1) // SUBSETS]
                pick = np.flatnonzero(known & (_mix(terms + np.uint64(c) * _ODD) < np.uint64(rate * 2.0 ** 64)))
                r, v = rows[pick], value[pick]
            else:
                r, v = rows[known], value[known]
            if not len(r):
                continue
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            rank = np.arange(len(r)) - np.repeat(first, np.diff(np.concatenate([first, [len(r)]])))
            got = _mix(np.add.reduceat(v * powers[rank], first))
            out[r[first], c] = np.maximum(got >> np.uint64(32), np.uint64(1))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal subset hashes at the rate that shows most, among subsets that hold a term
    of either text; equal fingerprints are 1."""
    held, same = (a > 0) | (b > 0), (a == b) & (a > 0)
    pooled = same.sum(axis=1) / np.maximum(held.sum(axis=1), 1)
    best = np.full(len(a), -1.0)
    for i in range(len(RATES)):
        s = slice(1 + i * SUBSETS, 1 + (i + 1) * SUBSETS)
        n = held[:, s].sum(axis=1)
        best = np.maximum(best, np.where(n >= LEAST_HELD, same[:, s].sum(axis=1) / np.maximum(n, 1), -1.0))
    return np.where((a == b).all(axis=1), 1.0, np.where(best >= 0, best, pooled))


def hexed(parts: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in parts.astype(">u4")]


def fingerprint_texts(texts: list[str], lex: np.ndarray) -> np.ndarray:
    """Component hashes of each text, a bounded slice at a time."""
    done, start, held = [], 0, 0
    for i in range(len(texts) + 1):
        if i == len(texts) or (i > start and held + len(texts[i]) > SLICE_BYTES // 2):
            if i > start:
                done.append(components(*distinct_terms(pa.array(texts[start:i], pa.string())), i - start, lex))
            start, held = i, 0
        held += len(texts[i]) if i < len(texts) else 0
    return np.concatenate(done) if done else np.zeros((0, COMPONENTS), np.uint32)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", lex: np.ndarray | None = None) -> DataFrame:
    """``key, fingerprint`` of each row's whole text."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon(df, text) if lex is None else lex)
    kind = df.schema[key].dataType.simpleString()

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        parts = components(*distinct_terms(part.column(1)), part.num_rows, shared.value)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(hexed(parts), pa.string())], [key, "fingerprint"])

    return map_texts(df, [key, text], text, f"`{key}` {kind}, fingerprint string", step)


def in_key_order(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows dealt into key ranges (column ``pid``), each with the first row of the next range in
    it (``head`` true; after the last range: the first). Range bounds and first keys are one
    number a range."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))
    bounds = sorted(set(df.approxQuantile(key, [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    pid = F.lit(0)
    if bounds:
        edges = F.array(*[F.lit(float(b)) for b in bounds])
        pid = F.coalesce(F.size(F.filter(edges, lambda b: b <= F.col(key))), F.lit(0))
    firsts = (df.select(key).groupBy(pid.alias("pid"))
              .agg(F.min(key).alias("k"), F.count_if(F.col(key).isNull()).alias("nulls")).orderBy("pid").collect())
    heads = None
    for i, r in enumerate(firsts):
        after = firsts[(i + 1) % len(firsts)]
        want = F.col(key).isNull() if after["nulls"] else F.col(key) == F.lit(after["k"])
        case = F.when(want, F.lit(r["pid"]))
        heads = case if heads is None else heads.when(want, F.lit(r["pid"]))
    rows = rows.withColumn("pid", pid).withColumn("head", F.lit(False))
    if heads is not None:
        keys = [r["k"] for r in firsts if r["k"] is not None]
        chosen = df.filter(F.col(key).isin(keys) | F.col(key).isNull()) if any(r["nulls"] for r in firsts) else df.filter(F.col(key).isin(keys))
        first = chosen.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text)).groupBy(key).agg(F.min(text).alias(text))
        first = first.withColumn("pid", heads).filter("pid is not null").withColumn("head", F.lit(True))
        rows = rows.unionByName(first)
    return rows.repartitionById(parts, F.col("pid")).sortWithinPartitions("head", F.col(key).asc_nulls_first(), text)


def edited_likeness(df: DataFrame, key: str = "doc_id", text: str = "text", lex: np.ndarray | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text: its last quarter replaced by the start
    of the next text in key order."""
    import hashlib
    shared = df.sparkSession.sparkContext.broadcast(lexicon(df, text) if lex is None else lex)
    kind = df.schema[key].dataType.simpleString()
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def rows_out(keys, texts):
        """Rows of all texts but the last, which is the next of the one before it."""
        edited = []
        for a, b in zip(texts, texts[1:]):
            cut = len(a) // 4
            edited.append(a[:len(a) - cut] + b[:cut])
        own, changed = fingerprint_texts(texts, shared.value), fingerprint_texts(edited, shared.value)
        mine = own[:-1]
        return pa.RecordBatch.from_arrays([
            pa.array(keys[:-1], pa_kind), pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(hexed(mine)),
            pa.array(hexed(changed)), pa.array(likeness(mine, changed)), pa.array(likeness(mine, own[1:]))], names)

    pa_kind = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())

    def run(batches):
        keys, texts, held = [], [], 0
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(k)
                texts.append(t)
                held += len(t)
                if held > SLICE_BYTES // 2 and len(texts) > 1:
                    yield rows_out(keys, texts)
                    keys, texts, held = keys[-1:], texts[-1:], len(t)
        if len(texts) > 1:
            yield rows_out(keys, texts)

    schema = (f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    return in_key_order(df, key, text).select(key, text).mapInArrow(run, schema)
