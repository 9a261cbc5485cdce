"""Fill-in-middle transformation with content-defined chunks.

A text's units are the matches of ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``: words with the
space before them, and the space after the last word. A unit ends where space follows other
characters, or at the end of the text, so cuts are found by counting such breaks:

1. A gear rolling hash over the UTF-8 bytes cuts the texts into chunks where its lowest bits are zero: equal
   passages give equal chunks, wherever they stand.
2. A worker keeps the summary of each distinct chunk under the chunk's own bytes, so a shared chunk is
   known by its content: breaks inside, whether it starts and ends with space, code points.
3. Summaries combine: a chunk of leading space after one that ends without adds a break. Running
   counts over a document's chunks give its number of units, the chunk of each cut and the code
   points before it; only those chunks are searched.

Cuts and form follow from the key alone: of the hex sha256 of ``seed:key`` the first four groups
of eight digits give two cuts (remainders by units + 1), whether the text is transformed, and whether the suffix
leads. ``transform`` keeps whole texts; ``restored`` rebuilds them from output and form.

Rows: ``key, n, form, prefix_chars, middle_chars, output``, one a row of the table, repeated keys
included. A null text is empty; a null key counts as an empty one. Empty texts and texts that hold a marker are plain. Empty tables give no
rows. Only the named columns are read. One text is held whole by a task.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchsmith.llm.common import map_texts, texts_of, worker_state

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PERCENT, SUFFIX_FIRST = 42, 50, 80
# Mean chunk is 2 ** MASK_BITS bytes; the hash sees the last WINDOW bytes.
MASK_BITS, WINDOW = 8, 32
# Bytes of chunks a worker remembers in each of two generations.
CACHE_BYTES = 16 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash of the last ``WINDOW`` bytes at each place: each byte's number, shifted by its age."""
    table = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, dtype=np.uint32)
    h = table[data]
    age = 1
    while age < WINDOW:  # sums over 2, 4, 8, ... bytes
        older = np.zeros_like(h)
        older[age:] = h[:-age] << np.uint32(age) if len(h) > age else 0
        h, age = h + older, 2 * age
    return h


def chunk_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """First bytes of the chunks of consecutive texts that begin at ``starts`` (rising; none empty)."""
    h = gear(data) >> np.uint32(32 - MASK_BITS)
    hit = h == 0
    hit[1:] &= h[:-1] != 0  # a run of hits, as in a run of one byte, is one cut
    cut = np.flatnonzero(hit) + 1
    since = cut - starts[np.searchsorted(starts, cut, "right") - 1]
    # near a start the hash would depend on the text before
    return np.union1d(cut[(since >= WINDOW) & (cut < len(data))], starts)


def breaks(space: np.ndarray) -> np.ndarray:
    """Places where space follows other characters."""
    return np.flatnonzero(space[1:] & ~space[:-1]) + 1


def summary(chunk: bytes) -> tuple[int, int, int, int]:
    """(breaks inside, starts with space, ends with space, code points)."""
    data = np.frombuffer(chunk, np.uint8)
    space = SPACE[data]
    return len(breaks(space)), int(space[0]), int(space[-1]), int(np.count_nonzero((data & 0xC0) != 0x80))


class Summaries:
    """Chunk summaries by content, in two generations: what the older one holds and nobody asked
    for again is forgotten when the newer one is full."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.new, self.old, self.held = limit, {}, {}, 0

    def of(self, chunk: bytes) -> tuple[int, int, int, int]:
        found = self.new.get(chunk)
        if found is None:
            found = self.old.get(chunk) or summary(chunk)
            self.held += len(chunk) + 200
            if self.held > self.limit:
                self.new, self.old, self.held = {}, self.new, len(chunk) + 200
            self.new[chunk] = found
        return found


def cuts(col: pa.Array, draws: np.ndarray, known: Summaries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, byte places of both cuts, code points before both cuts) of each text; ``draws`` are
    two numbers a text whose remainders by units + 1 choose the cuts."""
    n_rows = len(col)
    if not n_rows:
        return np.zeros(0, np.int64), np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + n_rows + 1].astype(np.int64)
    head, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    offsets -= head
    raw = col.buffers()[2].slice(head, size).to_pybytes() if size else b""
    data = np.frombuffer(raw, np.uint8)
    held = np.flatnonzero(np.diff(offsets))
    units, place, chars = np.zeros(n_rows, np.int64), np.zeros((n_rows, 2), np.int64), np.zeros((n_rows, 2), np.int64)
    if not len(held):
        return units, place, chars
    first = chunk_starts(data, offsets[held])
    stop = np.append(first[1:], len(data))
    found = np.array([known.of(raw[i:j]) for i, j in zip(first.tolist(), stop.tolist())], np.int64)
    lead = np.searchsorted(first, offsets[held])  # first chunk of each text
    last = np.append(lead[1:], len(first)) - 1
    joined = np.zeros(len(first), np.int64)
    joined[1:] = (found[1:, 1] == 1) & (found[:-1, 2] == 0)
    joined[lead] = 0
    before = np.concatenate([[0], np.cumsum(found[:, 0] + joined)])
    points = np.concatenate([[0], np.cumsum(found[:, 3])])
    n_breaks = before[last + 1] - before[lead]
    # the last unit has no break after it: a word at the end, or the space after the last word
    units[held] = n_breaks + 1
    pick = (draws[held] % (units[held, None] + 1)).astype(np.int64)
    pick.sort(axis=1)
    for side in range(2):
        k = pick[:, side]
        at, code = offsets[held].copy(), np.zeros(len(held), np.int64)
        whole = k > n_breaks
        at[whole], code[whole] = offsets[held + 1][whole], (points[last + 1] - points[lead])[whole]
        rows = np.flatnonzero((k > 0) & ~whole)
        target = before[lead[rows]] + k[rows]
        chunk = np.searchsorted(before, target, "left") - 1
        for r, c, t in zip(rows.tolist(), chunk.tolist(), target.tolist()):
            i, j = int(first[c]), int(stop[c])
            nth = t - int(before[c]) - 1 - int(joined[c])  # of the breaks inside; -1: at the chunk's start
            here = i if nth < 0 else i + int(breaks(SPACE[data[i:j]])[nth])
            at[r] = here
            code[r] = points[c] - points[lead[r]] + np.count_nonzero((data[i:here] & 0xC0) != 0x80)
        place[held, side], chars[held, side] = at - offsets[held], code
    return units, place, chars


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, percent: int = PERCENT,
              suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``key, n, form, prefix_chars, middle_chars, output`` of every row (see the module)."""
    kind = df.schema[key].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), digest.alias("digest"))

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        col = texts_of(part.column("text"))
        draws = np.array([[int(d[i:i + 8], 16) for i in (0, 8, 16, 24)] for d in part.column("digest").to_pylist()], np.int64).reshape(-1, 4)
        state = worker_state().setdefault("chunk_summaries", None) or Summaries()
        worker_state()["chunk_summaries"] = state
        units, place, chars = cuts(col, draws[:, :2], state)
        plain = pc.equal(col, "").to_numpy(zero_copy_only=False).astype(bool) | (draws[:, 2] % 100 >= percent)
        for marker in (PREFIX, SUFFIX, MIDDLE):
            plain |= pc.match_substring(col, marker).to_numpy(zero_copy_only=False).astype(bool)
        spm = draws[:, 3] % 100 < suffix_first
        out = []
        for whole, here, lead, (a, b) in zip(col.cast(pa.binary()), plain.tolist(), spm.tolist(), place.tolist()):
            raw = whole.as_py()
            if here:
                out.append(raw)
                continue
            p, s, m = (t.encode() for t in (PREFIX, SUFFIX, MIDDLE))
            out.append(s + raw[b:] + p + raw[:a] + m + raw[a:b] if lead else p + raw[:a] + s + raw[b:] + m + raw[a:b])
        form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
        return pa.RecordBatch.from_arrays(
            [part.column("key"), pa.array(units), pa.array(form), pa.array(chars[:, 0], mask=plain),
             pa.array(chars[:, 1] - chars[:, 0], mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
            ["key", "n", "form", "prefix_chars", "middle_chars", "output"])

    out = map_texts(rows, ["key", "text", "digest"], "text",
                    f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string", step)
    return out.withColumnRenamed("key", key)


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form stand for: a transformed text holds no marker of its own."""
    parts = F.split(output, "<[PSM]>")
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))
