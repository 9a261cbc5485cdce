"""N-gram Jaccard join by MinHash banding.

1. One pass gives every text its word n-grams (64-bit hashes; a text of fewer words is one
   n-gram), a digest of the set, and band hashes. Band and row counts follow from the threshold
   and the target recall (``banding``).
2. Texts of one n-gram set are one class; its document of least id stands for it.
3. Classes that share a band hash are a bucket. Buckets of the very same classes count once: the one of
   the lowest band stays, so the lowest band that two classes share is always there.
4. The texts of a bucket go to one place, or, if it holds more than ``BLOCK`` classes, to one place a
   pair of its blocks. A place compares, on full n-gram sets, the pairs whose lowest shared band is
   the bucket's, so a pair is compared once and only if it shares a band. It gives each class its
   number of linked documents, and each linked class the least of those it is connected with there:
   rows follow the classes, never the pairs, and no link is lost.
5. Components of these are near-duplicate classes.

Rows: ``doc_id, class_id`` (least id of the class of near copies), ``copy_id`` (least id with
the same n-gram set), ``n_links`` (other documents with similarity at or over the threshold).

A document is one id: of rows that repeat an id the one of least set digest counts. Rows without
an id, and texts without words (null, empty), link to nothing; the former are one row each with a null
class. Empty tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchsmith.llm.common import Scratch, map_texts, texts_of
from matchsmith.llm.components import connected_components, local_components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
# Most hash functions a text is signed with; more rows a band make fewer false candidates.
MAX_HASHES = 128
BLOCK = 256
SLICE = 1 << 20
# Columns of the incidence matrix of a pair of blocks held at a time.
COLUMNS = 4096

_WORD_KEY = "n-gram-word-key0"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def banding(threshold: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which a pair at the threshold shares a band with
    probability ``recall`` or more, within ``max_hashes`` hashes."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - min(threshold, 1 - 1e-9))), 1)
    for rows in range(2, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-min(threshold, 1 - 1e-9) ** rows))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(flat distinct n-gram hashes, sorted within each row; number by row)."""
    lists = pc.ascii_split_whitespace(texts_of(col))
    words = lists.values.dictionary_encode()
    rows = np.repeat(np.arange(len(col)), np.diff(lists.offsets.to_numpy()))
    real = pc.not_equal(lists.values, "").to_numpy(zero_copy_only=False).astype(bool)
    codes, rows = words.indices.to_numpy()[real], rows[real]
    if not len(codes):
        return np.empty(0, np.uint64), np.zeros(len(col), np.int64)
    hashes = pd.util.hash_array(words.dictionary.to_numpy(zero_copy_only=False), hash_key=_WORD_KEY, categorize=False)[codes]
    count = np.bincount(rows, minlength=len(col))
    start = np.cumsum(count) - count
    grams = np.maximum(count - n + 1, np.minimum(count, 1))  # a short text is one n-gram
    first = np.repeat(start - (np.cumsum(grams) - grams), grams) + np.arange(int(grams.sum()))
    row = np.repeat(np.arange(len(col)), grams)
    last = (start + count)[row]
    value = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            at = first + k
            inside = at < last
            value = np.where(inside, _mix(value * _ODD + hashes[np.minimum(at, len(hashes) - 1)]), value)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    keep = np.concatenate([[True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])])
    return value[keep], np.bincount(row[keep], minlength=len(col))


def _offsets(count: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(count)]).astype(np.int64)


def _digests(flat: np.ndarray, count: np.ndarray) -> list[bytes | None]:
    at = _offsets(count)
    return [hashlib.blake2b(flat[i:j].tobytes(), digest_size=16).digest() if j > i else None for i, j in zip(at[:-1], at[1:])]


def _bands(flat: np.ndarray, count: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Rows x bands band hashes; rows without n-grams are zero."""
    out = np.zeros((len(count), bands), np.uint64)
    held = np.flatnonzero(count)
    if not len(held):
        return out
    first = (np.cumsum(count) - count)[held]
    x = (flat >> np.uint64(32)).astype(np.uint32)
    y = (flat & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
    rng = np.random.Generator(np.random.PCG64(20))
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.zeros(len(held), np.uint64)
            for _ in range(rows):
                p, q = (np.uint32(v) for v in rng.integers(1, 1 << 32, 2, dtype=np.uint64))
                least = np.minimum.reduceat((x * (p | np.uint32(1))) ^ (y * (q | np.uint32(1))), first)
                h = _mix(h * _ODD + least)
            out[held, b] = h
    return out


def signatures(df: DataFrame, key: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """``key, digest, bands array<long>`` of each row."""
    kind = df.schema[key].dataType.simpleString()

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        flat, count = ngrams(part.column(1), n)
        signed = _bands(flat, count, bands, rows).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(count) * bands + 1, bands, dtype=np.int32)), pa.array(signed.ravel()))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(_digests(flat, count), pa.binary()), lists], [key, "digest", "bands"])

    return map_texts(df, [key, text], text, f"`{key}` {kind}, digest binary, bands array<long>", step, SLICE)


def similar_pairs(sets: list[np.ndarray], wanted: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j, among those ``wanted`` marks, of sets with Jaccard similarity at or over the threshold."""
    sizes = np.array([len(s) for s in sets], np.int64)
    n = len(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[code] > 1  # an n-gram of one set is in no intersection
    code, owner = np.unique(code[shared], return_inverse=True)[1], owner[shared]
    common = np.zeros((n, n), np.float64)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        lo, hi = np.searchsorted(code, [start, start + COLUMNS])
        held = np.zeros((n, min(COLUMNS, int(code[-1]) + 1 - start)), np.float32)
        held[owner[lo:hi], code[lo:hi] - start] = 1
        common += held @ held.T
    union = sizes[:, None] + sizes[None, :] - common
    return np.nonzero(wanted & (common >= threshold * union - 1e-9))


def first_shared(bands: np.ndarray, side: np.ndarray, paired: bool) -> np.ndarray:
    """Pairs i < j (of both sides, if ``paired``) that share none of the earlier ``bands``."""
    n = len(bands)
    own = np.triu(np.ones((n, n), bool), 1)
    if paired:
        own &= side[:, None] != side[None, :]
    for b in bands.T:
        own &= b[:, None] != b[None, :]
    return own


def verified(placed: DataFrame, n: int, threshold: float) -> DataFrame:
    """From rows ``place, side, paired, id, digest, members, earlier, text``, sorted by place: rows
    ``id, links, least``: of a class with links there, the documents it links to, and the least
    class it is connected with (null if it is that itself)."""
    schema = "id long, links long, least long"

    def run(batches):
        held, place = [], None
        for batch in batches:
            keys = batch.column("place").to_pylist()
            start = 0
            for at in range(1, len(keys) + 1):
                if at == len(keys) or keys[at] != keys[start]:
                    if place is not None and keys[start] != place:
                        yield from compared(held)
                        held = []
                    held.append(batch.slice(start, at - start))
                    place, start = keys[start], at
        if held:
            yield from compared(held)

    def compared(held):
        rows = pa.Table.from_batches(held).combine_chunks()
        bands = np.array(rows["earlier"].to_pylist(), np.int64).reshape(rows.num_rows, -1)
        own = first_shared(bands, rows["side"].to_numpy(), bool(rows["paired"][0].as_py()))
        rows = rows.append_column("at", pa.array(np.arange(rows.num_rows))).filter(pa.array(own.any(axis=0) | own.any(axis=1)))
        if not rows.num_rows:
            return
        flat, count = ngrams(rows["text"].combine_chunks(), n)
        at = _offsets(count)
        digest = _digests(flat, count)
        mine = np.array([k for k, d in enumerate(rows["digest"].to_pylist()) if d == digest[k]], np.int64)
        if not len(mine):
            return
        ids = rows["id"].to_numpy()[mine]
        _, first = np.unique(ids, return_index=True)  # a repeated row is one class; ids rise
        mine = mine[first]
        ids, members = rows["id"].to_numpy()[mine], rows["members"].to_numpy()[mine]
        if len(ids) < 2:
            return
        place = rows["at"].to_numpy()[mine]
        wanted = own[np.ix_(place, place)]
        i, j = similar_pairs([flat[at[k]:at[k + 1]] for k in mine], wanted | wanted.T, threshold)
        i, j = i[i < j], j[i < j]
        if not len(i):
            return
        links = np.bincount(i, weights=members[j], minlength=len(ids)) + np.bincount(j, weights=members[i], minlength=len(ids))
        linked = np.flatnonzero(links)
        least = ids[local_components(len(ids), i, j)][linked]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[linked]), pa.array(links[linked].astype(np.int64)), pa.array(least, mask=least == ids[linked])],
            ["id", "links", "least"])

    return placed.mapInArrow(run, schema)


def near_join(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD,
              recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``key, class_id, copy_id, n_links`` of every document (see the module)."""
    spark = df.sparkSession
    scratch = Scratch(spark, "near-join")
    bands, rows = banding(threshold, recall)
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    signed = scratch.table(signatures(docs, "id", "text", words, bands, rows), "signatures")
    known = signed.filter("id is not null and digest is not null")
    by_doc = known.groupBy("id").agg(F.min("digest").alias("digest"))
    classes = scratch.table(by_doc.groupBy("digest").agg(F.min("id").alias("copy_id"), F.count(F.lit(1)).alias("members")), "classes")

    signed_classes = known.join(classes.select("digest", F.col("copy_id").alias("id"), "members"), ["digest", "id"])
    in_buckets = signed_classes.select("id", F.posexplode("bands").alias("band", "bucket"))
    part = lambda seed: F.sum(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 31)))
    buckets = (in_buckets.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max("id").alias("most"),
                                                        part(0).alias("mark0"), part(1).alias("mark1"))
               .filter("n > 1 and least < most"))
    kept = (buckets.groupBy("n", "least", "most", "mark0", "mark1").agg(F.min(F.struct("band", "bucket")).alias("b"))
            .select("b.band", "b.bucket", F.ceil(F.col("n") / F.lit(block)).alias("blocks")))
    wanted = scratch.table(
        in_buckets.join(kept, ["band", "bucket"]).distinct().groupBy("id").agg(F.collect_list(F.struct("band", "bucket", "blocks")).alias("buckets"))
        .join(signed_classes.dropDuplicates(["id"]), "id"), "wanted")
    texts = docs.join(wanted, "id").select("*", F.explode("buckets").alias("b"))
    own = F.pmod(F.xxhash64("id"), F.col("b.blocks"))
    placed = (texts.select("*", own.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("b.blocks") - 1)).alias("partner"))
              .select(F.concat_ws("/", "b.band", "b.bucket", F.least("block", "partner"), F.greatest("block", "partner")).alias("place"),
                      (F.col("block") > F.col("partner")).cast("int").alias("side"), (F.col("block") != F.col("partner")).alias("paired"),
                      "id", "digest", "members", F.slice("bands", F.lit(1), F.col("b.band")).alias("earlier"), "text"))
    found = scratch.table(verified(placed.repartition("place").sortWithinPartitions("place", "id"), words, threshold), "links")

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    near = connected_components(found.filter("least is not null").select(F.col("id").alias("a"), F.col("least").alias("b")), scratch)
    table = (classes.withColumn("id", F.col("copy_id")).join(links, "id", "left").join(near, "id", "left")
             .select("digest", "copy_id", F.coalesce("component", "copy_id").alias("class_id"),
                     (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    out = by_doc.join(table, "digest").select(F.col("id").alias(key), "class_id", "copy_id", "n_links")
    rest = signed.filter("id is not null").groupBy("id").agg(F.count("digest").alias("n")).filter("n = 0")
    alone = lambda d: d.select(F.col("id").alias(key), F.col("id").alias("class_id"), F.col("id").alias("copy_id"),
                               F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone(rest)).unionByName(alone(signed.filter("id is null")))
