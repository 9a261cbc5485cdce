"""Token ids in binary files: canonical length-limited Huffman codes from global id counts.

* Ids are counted over the whole table; code lengths come from the counts by the package-merge
  method (no code over ``MAX_BITS``), codes are canonical, so a file needs only the lengths.
* Files hold ascending keys. A file is a run of independent blocks of about ``BLOCK_IDS`` ids.
  A block has its rows' lengths, the bits, and a checkpoint (bit offset) at every row's start
  and after every ``STRIDE`` ids of a row, so that any stretch can be decoded by itself.
* Decoding is driven by a table: the next ``MAX_BITS`` bits give the id and its code's length.
  All stretches of a block advance together, one id each step.

Null texts give the end id alone. Equal keys follow one another ordered by their ids; a null
key comes first. Empty tables give no files and empty results. Only the named columns are read.

File: magic ``HID1``, then blocks. Block: little-endian u32 rows, u32 ids, u32 stretches, u32 words;
i64 keys, u8 null-key flags, u32 ids by row, u64 bit offsets of stretches, u64 words of bits, the
first id of a row at the highest bit of a word of its own. The code lengths are in the folder's table of files.
"""

from __future__ import annotations

import struct
import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchsmith.llm.common import Scratch, bands_of, map_texts, read_bytes, vocabulary_path
from matchsmith.llm.files import read_range, write_file
from matchsmith.llm.vocabularies import JsonVocabulary, vocabulary, with_ends

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOCABULARY = "byte_bpe_50k.json"
MAX_BITS = 20
BLOCK_IDS = 1 << 20
STRIDE = 256
MAGIC = b"HID1"
# Ids in one output file, about; files are the unit of the write tasks.
FILE_IDS = 16 << 20


def encode_ids(df: DataFrame, key: str, text: str, path: str, end: int) -> DataFrame:
    """``key, n_ids, ids`` (little-endian u16, or u32 for large vocabularies) of whole texts."""
    blob = df.sparkSession.sparkContext.broadcast(read_bytes(df.sparkSession, path))
    width = id_width(df.sparkSession, path, end)
    kind = df.schema[key].dataType.simpleString()

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(JsonVocabulary, blob.value, path)
        ids, lens = v.encode(part.column(1))
        ids, offsets = with_ends(ids, lens, end)
        blobs = binary_rows(ids.astype(f"<u{width}"), offsets)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), blobs], [key, "n_ids", "ids"])

    return map_texts(df, [key, text], text, f"`{key}` {kind}, n_ids long, ids binary", step)


def id_width(spark: SparkSession, path: str, end: int) -> int:
    size = vocabulary(JsonVocabulary, read_bytes(spark, path), path).size
    return 2 if max(size, end + 1) <= 1 << 16 else 4


def binary_rows(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary array whose row i holds the bytes of ``values[offsets[i]:offsets[i+1]]``."""
    at = (offsets * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(at), pa.py_buffer(values)])


def rows_of_binary(col: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, offsets) of a binary array."""
    n = len(col)
    item = np.dtype(dtype).itemsize
    at = np.frombuffer(col.buffers()[1], np.int32, n + 1, col.offset * 4).astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", dtype, int(at[-1] - at[0]) // item, int(at[0])) if n else np.empty(0, dtype)
    return data, (at - at[0]) // item


def id_counts(ids: DataFrame, width: int) -> DataFrame:
    """``id, n`` over all rows; tasks count first, so at most (tasks x vocabulary) rows move."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            got = np.bincount(rows_of_binary(b.column(0), f"<u{width}")[0])
            if len(got) > len(total):
                total = np.concatenate([total, np.zeros(len(got) - len(total), np.int64)])
            total[:len(got)] += got
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["id", "n"])

    return ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal prefix-code lengths of at most ``max_bits`` (package-merge); 0 where the count is 0."""
    held = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(held) <= 1:
        lengths[held] = 1
        return lengths
    if len(held) > 1 << max_bits:
        raise ValueError(f"{len(held)} ids need more than {max_bits} bits")
    order = np.argsort(counts[held], kind="stable")
    weights = counts[held][order].astype(np.float64 if counts.sum() > 1 << 53 else np.int64)
    merged, levels = weights, []
    for _ in range(max_bits - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(weights))  # a leaf, else a package of two of the level below
        merged = both[rank]
    take, depth = 2 * len(held) - 2, np.zeros(len(held), np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    depth[:take] += 1
    lengths[held[order]] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id), as unsigned integers of ``lengths`` bits."""
    codes = np.zeros(len(lengths), np.uint64)
    held = np.flatnonzero(lengths)
    held = held[np.argsort(lengths[held], kind="stable")]
    if len(held):
        top = int(lengths[held].max())
        spans = np.left_shift(np.uint64(1), (top - lengths[held]).astype(np.uint64))
        starts = np.cumsum(spans) - spans
        codes[held] = starts >> (top - lengths[held]).astype(np.uint64)
    return codes


def pack_rows(ids: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, codes: np.ndarray):
    """(u64 words, first word of each row and of the end, bit offset of each id): every row starts a word."""
    size = lengths[ids].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    row_bits = ends[offsets[1:]] - ends[offsets[:-1]]
    first_word = np.concatenate([[0], np.cumsum((row_bits + 63) >> 6)])
    at = ends[:-1] + np.repeat((first_word[:-1] << 6) - ends[offsets[:-1]], np.diff(offsets))
    words = np.zeros(int(first_word[-1]) + 1, np.uint64)
    if len(ids):
        word, place = at >> 6, at & 63
        code = codes[ids]
        room = 64 - place - size  # negative: the code runs into the next word
        inside = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64),
                          code >> np.maximum(-room, 0).astype(np.uint64))
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] = np.bitwise_or.reduceat(inside, first)
        over = np.flatnonzero(room < 0)
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return words[:-1], first_word, at


def decode_table(lengths: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(id, code length) for every possible next ``max_bits`` bits."""
    held = np.flatnonzero(lengths)
    held = held[np.argsort(lengths[held], kind="stable")]
    spans = np.left_shift(1, max_bits - lengths[held].astype(np.int64))
    total = 1 << max_bits
    ids, bits = np.zeros(total, np.int32), np.ones(total, np.uint8)
    n = int(spans.sum())
    ids[:n], bits[:n] = np.repeat(held, spans), np.repeat(lengths[held], spans)
    return ids, bits


def unpack_bits(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, table, max_bits: int = MAX_BITS) -> np.ndarray:
    """Ids of stretches that begin at bit ``starts`` and hold ``sizes`` ids, one after another."""
    ids, bits = table
    out = np.empty(int(sizes.sum()), np.int32)
    place = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")  # those still running stay in front
    pos, put = starts[order].astype(np.int64), place[order]
    running = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
    shift = np.uint64(64 - max_bits)
    for step, n in enumerate(running):
        p = pos[:n]
        word, off = p >> 6, (p & 63).astype(np.uint64)
        high = words[word] << off
        low = np.where(off > 0, words[word + 1] >> ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        window = (high | low) >> shift
        out[put[:n] + step] = ids[window]
        pos[:n] = p + bits[window]
    return out


def stretches(lens: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """(first id, number of ids) of the stretches of consecutive rows of ids."""
    count = -(-lens // stride)
    row = np.repeat(np.arange(len(lens)), count)
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    begin = (np.cumsum(lens) - lens)[row] + nth * stride
    return begin, np.minimum(lens[row] - nth * stride, stride)


def block_bytes(keys: np.ndarray, null: np.ndarray, lens: np.ndarray, starts: np.ndarray, words: bytes) -> bytes:
    """One block from its rows' coded words; two words of zeros let the decoder look ahead."""
    words += bytes(16)
    return b"".join([struct.pack("<4I", len(keys), int(lens.sum()), len(starts), len(words) // 8), keys.astype("<i8").tobytes(),
                     null.astype("u1").tobytes(), lens.astype("<u4").tobytes(), starts.astype("<u8").tobytes(), words])


def read_block(raw: bytes, table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, null-key flags, ids, number of ids by row)."""
    rows, n, parts, n_words = struct.unpack_from("<4I", raw)
    at = 16
    held = []
    for dtype, count in (("<i8", rows), ("u1", rows), ("<u4", rows), ("<u8", parts), ("<u8", n_words)):
        held.append(np.frombuffer(raw, dtype, count, at))
        at += held[-1].nbytes
    keys, null, lens, starts, words = held
    lens = lens.astype(np.int64)
    return keys, null, unpack_bits(words.astype(np.uint64), starts.astype(np.int64), stretches(lens)[1], table), lens


def _bounds(df: DataFrame, key: str, parts: int) -> list:
    if parts <= 1:
        return []
    found = df.filter(F.col(key).isNotNull()).approxQuantile(key, [i / parts for i in range(1, parts)], 1 / (8 * parts))
    return [int(b) for b in found]


def write(ids: DataFrame, key: str, folder: str, width: int, max_bits: int = MAX_BITS, file_ids: int = FILE_IDS) -> DataFrame:
    """Write a table of ids (from ``encode_ids``, a stored table) as files of ascending keys under
    ``folder``; returns the table of blocks, which is also stored in the folder.

    Rows are coded before they are shuffled by key range; range bounds are quantiles of the key
    (one number a file). Equal keys that fill several ranges are spread over them.
    """
    spark = ids.sparkSession
    counts = id_counts(ids, width).orderBy("id").toPandas()  # one row an id of the vocabulary at most
    freq = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.int64)
    freq[counts["id"].to_numpy()] = counts["n"].to_numpy()
    lengths = code_lengths(freq, max_bits)
    shared = spark.sparkContext.broadcast(lengths)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), int(freq.sum()) // file_ids)
    bounds = spark.sparkContext.broadcast(np.array(_bounds(ids, key, parts), np.int64))
    dtype = f"<u{width}"

    def coded(batches):
        codes = canonical_codes(shared.value)
        for batch in batches:
            for lo, hi in bands_of(batch.column(1).to_numpy() * 8, 4 << 20):
                part = batch.slice(lo, hi - lo)
                flat, at = rows_of_binary(part.column(2), dtype)
                words, first_word, bit = pack_rows(flat, at, shared.value, codes)
                lens = np.diff(at)
                begin, _ = stretches(lens)
                n_parts = -(-lens // STRIDE)
                own = bit[begin] - np.repeat(first_word[:-1] << 6, n_parts)
                key_col = part.column(0)
                k = pc.fill_null(key_col, 0).to_numpy()
                first, last = np.searchsorted(bounds.value, k, "left"), np.searchsorted(bounds.value, k, "right")
                tie = np.zeros(len(k), np.int64)
                for i in np.flatnonzero(first < last):  # one key fills several ranges: spread its rows
                    tie[i] = zlib.crc32(flat[at[i]:at[i + 1]].tobytes())
                pid = first + tie % (last - first + 1)
                pid[pc.is_null(key_col).to_numpy(zero_copy_only=False)] = 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pid.astype(np.int32)), key_col, part.column(1), binary_rows(words.astype("<u8"), first_word),
                     binary_rows(own.astype("<u8"), np.concatenate([[0], np.cumsum(n_parts)]))],
                    ["pid", key, "n_ids", "bits", "starts"])

    def filed(batches):
        """One file a range: its rows come sorted, and leave in blocks."""
        state = {"at": len(MAGIC), "made": []}

        def blocks():
            yield MAGIC
            held, size = [], 0
            for batch in batches:
                for lo, hi in bands_of(batch.column(2).to_numpy(), BLOCK_IDS):
                    part = batch.slice(lo, hi - lo)
                    n = int(pc.sum(part.column(2)).as_py())
                    if held and size + n > BLOCK_IDS:
                        yield block(held)
                        held, size = [], 0
                    held.append(part)
                    size += n
            if held:
                yield block(held)

        def block(held):
            rows = pa.Table.from_batches(held).combine_chunks()
            key_col, lens, bits, starts = (rows.column(i).combine_chunks() if isinstance(rows.column(i), pa.ChunkedArray)
                                           else rows.column(i) for i in (1, 2, 3, 4))
            words, at = rows_of_binary(bits, "<u8")
            own, parts = rows_of_binary(starts, "<u8")
            null = pc.is_null(key_col).to_numpy(zero_copy_only=False)
            raw = block_bytes(pc.fill_null(key_col, 0).to_numpy(), null, lens.to_numpy().astype(np.int64),
                              own.astype(np.int64) + np.repeat(at[:-1] << 6, np.diff(parts)), words.tobytes())
            state["made"].append((rows.column(0)[0].as_py(), state["at"], len(raw), len(lens), int(pc.sum(lens).as_py())))
            state["at"] += len(raw)
            return raw

        first = next(stream := blocks(), None)
        second = next(stream, None)
        if second is None:
            return
        def rest():
            yield first
            yield second
            yield from stream
        name = write_file(folder, "ids.hid", rest())
        cols = list(zip(*state["made"]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(cols[0])), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:]]],
            ["file", "pid", "at", "bytes", "n_rows", "n_ids"])

    kind = ids.schema[key].dataType.simpleString()
    rows = ids.select(key, "n_ids", "ids").mapInArrow(coded, f"pid int, `{key}` {kind}, n_ids long, bits binary, starts binary")
    made = (rows.repartitionById(parts, F.col("pid")).sortWithinPartitions(F.col(key).asc_nulls_first(), "bits")
            .mapInArrow(filed, "file string, pid int, at long, bytes long, n_rows long, n_ids long"))
    made.write.parquet(f"{folder}/_blocks")
    spark.createDataFrame([(bytearray(lengths.tobytes()), max_bits)], "lengths binary, max_bits int").coalesce(1).write.parquet(f"{folder}/_code")
    return spark.read.parquet(f"{folder}/_blocks")


def read(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """``key, start, n_ids, ids`` (little-endian u32) of every row of the files, block by block;
    ``start`` counts the ids of all rows before it."""
    code = spark.read.parquet(f"{folder}/_code").head()
    lengths = spark.sparkContext.broadcast(np.frombuffer(bytes(code["lengths"]), np.uint8))
    max_bits = code["max_bits"]
    blocks = spark.read.parquet(f"{folder}/_blocks")
    ranges = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # one short row a range of keys
    base = blocks.groupBy("pid").agg(F.sum("n_ids").alias("n")).select("pid", F.coalesce(F.sum("n").over(ranges), F.lit(0)).alias("base"))
    inside = Window.partitionBy("pid").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("within", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(base, "pid").withColumn("before", F.col("base") + F.col("within"))

    def run(batches):
        table = decode_table(lengths.value, max_bits)
        for batch in batches:
            for name, at, size, before in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                keys, null, ids, lens = read_block(read_range(folder, name, at, size), table)
                offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
                for lo, hi in bands_of(lens * 4, 8 << 20):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[lo:hi], mask=null[lo:hi].astype(bool)), pa.array(before + offsets[lo:hi]), pa.array(lens[lo:hi]),
                         binary_rows(ids[offsets[lo]:offsets[hi]].astype("<u4"), offsets[lo:hi + 1] - offsets[lo])],
                        [key, "start", "n_ids", "ids"])

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chosen = blocks.select("file", "at", "bytes", "before").repartition(parts, "file", "at")
    return chosen.mapInArrow(run, f"`{key}` long, start long, n_ids long, ids binary")


def store_ids(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str | None = None,
              end: int = 2) -> DataFrame:
    """Encode whole texts and write them as files under ``folder``; returns the table of blocks."""
    spark = df.sparkSession
    path = path or vocabulary_path(VOCABULARY)
    scratch = Scratch(spark, "ids")
    ids = scratch.table(encode_ids(df, key, text, path, end), "ids")
    blocks = write(ids, key, folder, id_width(spark, path, end))
    scratch.release(ids)
    return blocks
