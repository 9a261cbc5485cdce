"""Pattern packing of token pieces into sequences of a fixed capacity.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the driver:

1. patterns of one to three lengths that fill a sequence exactly are enumerated;
2. non-negative least squares fits their repeat counts to the histogram, rounded down to whole
   repeats that the histogram can supply;
3. the residual is packed by longest-first patterns of any number of lengths, each repeated as
   often as the histogram allows, so every step uses up a length.

The plan says which ranks of each length go to which sequences and offsets. Pieces get a rank
within their length (windows over hash buckets of bounded size, offset by bucket counts) and
look their place up. The plan has at most ``MAX_PATTERNS`` x 3 rows from step 2 and, as k
distinct lengths need k(k+1)/2 tokens, capacity x sqrt(2 x capacity) from step 3, whatever the
number of pieces.

Null texts count as empty and give a piece of the end id alone. Equal pieces (repeated rows)
each get a place. An empty table gives an empty result. Lengths outside 1..capacity raise.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchsmith.llm.common import map_texts, read_bytes, vocabulary_path
from matchsmith.llm.huffman import binary_rows
from matchsmith.llm.vocabularies import JsonVocabulary, vocabulary, with_ends

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
# Exact-fill patterns given to the least-squares fit: those whose rarest length is commonest.
MAX_PATTERNS = 200_000
ROUNDS = 150
# Pieces that one window ranks.
BUCKET_ROWS = 100_000


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, end: int = 1,
           capacity: int = CAPACITY) -> DataFrame:
    """``key, piece, start, length, ids`` (little-endian u32): whole texts with an end id, cut
    every ``capacity`` ids."""
    path = path or vocabulary_path(VOCABULARY)
    blob = df.sparkSession.sparkContext.broadcast(read_bytes(df.sparkSession, path))
    kind = df.schema[key].dataType.simpleString()

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(JsonVocabulary, blob.value, path)
        ids, lens = v.encode(part.column(1))
        ids, offsets = with_ends(ids, lens, end)
        sizes = np.diff(offsets)
        count = -(-sizes // capacity)
        row = np.repeat(np.arange(len(sizes)), count)
        piece = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        start = piece * capacity
        length = np.minimum(sizes[row] - start, capacity)
        at = np.concatenate([[0], np.cumsum(length)])
        return pa.RecordBatch.from_arrays(
            [part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
             binary_rows(ids.astype("<u4"), at)], [key, "piece", "start", "length", "ids"])

    return map_texts(df, [key, text], text, f"`{key}` {kind}, piece int, start long, length long, ids binary", step)


def exact_patterns(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Patterns (a, b, c), a >= b >= c, of held lengths that sum to ``capacity``; 0 is no length."""
    held = np.flatnonzero(counts)
    held = held[held > 0]
    has = np.zeros(capacity + 1, bool)
    has[held] = True
    found = [np.array([[capacity, 0, 0]])] if has[capacity] else []
    pair = held[(2 * held >= capacity) & (held < capacity)]
    pair = pair[has[capacity - pair]]
    found.append(np.stack([pair, capacity - pair, 0 * pair], axis=1))
    for a in held[(3 * held >= capacity) & (held < capacity - 1)]:
        b = held[(held <= a) & (2 * held >= capacity - a) & (held < capacity - a)]
        b = b[has[capacity - a - b]]
        if len(b):
            found.append(np.stack([0 * b + a, b, capacity - a - b], axis=1))
    rows = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    if len(rows) > MAX_PATTERNS:
        reach = np.where(rows > 0, counts[rows], counts.max()).min(axis=1)
        rows = rows[np.argsort(-reach, kind="stable")[:MAX_PATTERNS]]
    return rows.astype(np.int64)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least squares of ``sum_p repeats[p] * lengths of p ~ counts`` by multiplicative steps."""
    h = counts.astype(np.float64)
    h[0] = 0
    if not len(patterns):
        return np.empty(0)
    used = patterns > 0
    pull = (h[patterns] * used).sum(axis=1)
    x = pull / np.maximum(np.bincount(patterns[used], minlength=len(h))[patterns].max(axis=1), 1) / 3
    for _ in range(rounds):
        made = np.bincount(patterns[used], weights=np.repeat(x, used.sum(axis=1)), minlength=len(h))
        made[0] = 0
        x *= pull / np.maximum((made[patterns] * used).sum(axis=1), 1e-12)
    return x


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """(slots, number of sequences); a slot row is (length, first rank, ranks, per sequence,
    first sequence, offset): the ranks fill ``per sequence`` places side by side, sequence by sequence."""
    left = counts.astype(np.int64).copy()
    used = np.zeros_like(left)
    slots, sequences = [], 0

    def place(lengths: list[tuple[int, int]], repeats: int) -> None:
        nonlocal sequences
        offset = 0
        for length, times in lengths:
            slots.append((length, used[length], repeats * times, times, sequences, offset))
            used[length] += repeats * times
            left[length] -= repeats * times
            offset += length * times
        sequences += repeats

    patterns = exact_patterns(left, capacity)
    repeats = np.floor(fit_repeats(patterns, left) + 1e-9).astype(np.int64)
    for p in np.argsort(-repeats, kind="stable"):
        if not repeats[p]:
            break
        lengths = [(int(v), int(n)) for v, n in zip(*np.unique(patterns[p][patterns[p] > 0], return_counts=True))][::-1]
        n = min(int(repeats[p]), *(int(left[v]) // t for v, t in lengths))
        if n:
            place(lengths, n)

    held = [int(v) for v in np.flatnonzero(left)]  # ascending
    while held:
        room, at, lengths = capacity, len(held) - 1, []
        while at >= 0 and room >= held[0]:
            if held[at] > room:
                at = int(np.searchsorted(held[:at], room, side="right")) - 1
                continue
            times = min(room // held[at], int(left[held[at]]))
            lengths.append((held[at], times))
            room -= times * held[at]
            at -= 1
        place(lengths, min(int(left[v]) // t for v, t in lengths))
        held = [v for v in held if left[v]]
    return np.array(slots, np.int64).reshape(-1, 6), sequences


def pack(items: DataFrame, length: str = "length", order: list[str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to every row of ``items``, a stored table.

    ``order`` names the columns that tell rows apart (default: all); rows equal in them are alike.
    """
    spark = items.sparkSession
    order = order or items.columns
    sizes = items.groupBy(F.col(length).alias("length")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    if len(sizes) and (sizes["length"].isna().any() or sizes["length"].min() < 1 or sizes["length"].max() > capacity):
        raise ValueError(f"lengths must be 1 to {capacity}")
    counts = np.zeros(capacity + 1, np.int64)
    counts[sizes["length"].to_numpy(np.int64)] = sizes["n"].to_numpy(np.int64)
    slots, _ = plan(counts, capacity)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    shared = spark.sparkContext.broadcast(slots)

    many = [(int(v), int(counts[v] // BUCKET_ROWS + 1)) for v in np.flatnonzero(counts > BUCKET_ROWS)]
    buckets = F.lit(1)
    if many:  # lengths of one bucket need no entry
        table = F.create_map(*[F.lit(x) for pair in many for x in pair])
        buckets = F.coalesce(F.try_element_at(table, F.col(length).cast("int")), F.lit(1))
    rows = items.withColumn("__bucket", F.pmod(F.xxhash64(*order), buckets.cast("long")))
    sub = rows.groupBy(F.col(length).alias("__length"), "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sub = sub.select("__length", F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(length, "__bucket").orderBy(*order)
    rows = rows.withColumn("__rank", F.row_number().over(within).cast("long") - 1)
    rows = rows.join(sub, (F.col(length) == F.col("__length")) & (F.col("__bucket") == F.col("__b")))
    rows = rows.withColumn("__rank", F.col("__rank") + F.col("__before")).select(*items.columns, "__rank")
    names = list(items.columns)
    at, n = names.index(length), len(names)
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields) + ", sequence_id long, offset long"

    def run(batches):
        table = shared.value
        keys = (table[:, 0] << 48) + table[:, 1]
        for b in batches:
            rank = b.column(n).to_numpy().astype(np.int64)
            slot = table[np.searchsorted(keys, (b.column(at).to_numpy().astype(np.int64) << 48) + rank, side="right") - 1]
            nth = rank - slot[:, 1]
            sequence = slot[:, 4] + nth // slot[:, 3]
            offset = slot[:, 5] + nth % slot[:, 3] * slot[:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(sequence), pa.array(offset)],
                                             [*names, "sequence_id", "offset"])

    return rows.mapInArrow(run, out_schema)


def sequences(placed: DataFrame, ids: str = "ids") -> DataFrame:
    """``sequence_id, ids`` of packed pieces: the pieces' ids in order of their offsets. A
    sequence is bounded by the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex(ids).alias("h"))))
    return placed.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["h"]), "")).alias("ids"))
