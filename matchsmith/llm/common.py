"""Helpers shared by the operators: worker-side state, bounded slices, scratch tables, vocabularies."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from matchsmith.session import ensure_checkpoint_dir

# Executors need no copy of this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes of text that one vectorised step holds at a time.
SLICE_BYTES = 2 << 20


def worker_state() -> dict:
    """Dictionary that lives as long as the Python worker process, across its tasks."""
    name = "_matchsmith_worker_state"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name].__dict__


def text_bytes(col: pa.Array) -> np.ndarray:
    """UTF-8 length of each value (null: 0)."""
    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into consecutive slices of at most ``max_bytes`` of ``column`` (one row at least)."""
    sizes = text_bytes(batch.column(column))
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if batch.num_rows > start:
        yield batch.slice(start)


def texts_of(col: pa.Array) -> pa.Array:
    """Compact string array without nulls (null: empty)."""
    col = pc.fill_null(col.cast(pa.string()), "")
    return pa.concat_arrays([col]) if col.offset == 0 else pa.concat_arrays([col, pa.array([], pa.string())])


class Scratch:
    """Tables under the shared checkpoint folder that a query writes, rereads and releases.

    A written table cuts lineage and survives the loss of an executor, and its readers see one
    fixed row order. ``release`` drops those no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/matchsmith-llm/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, label: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{label}"

    def table(self, df: DataFrame, label: str, **options) -> DataFrame:
        path = self.path(label)
        df.write.options(compression="zstd", **options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._matchsmith_path = path  # for release
        return out

    def release(self, *tables: DataFrame) -> None:
        for t in tables:
            self.drop(t._matchsmith_path)

    def drop(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file: from a local path, or through Spark when the path names a store."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").head()[0])
    with open(path, "rb") as f:
        return f.read()


def vocabulary_path(name: str) -> str:
    """Default place of a public vocabulary file; every operator takes its path as a parameter."""
    import public_tokenizers
    return public_tokenizers.path(name)


def map_texts(df: DataFrame, columns: list[str], text: str, schema: str, step, max_bytes: int = SLICE_BYTES) -> DataFrame:
    """``step(slice) -> RecordBatch | None`` over bounded slices of the named columns, within the scan's tasks."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, text, max_bytes):
                out = step(part)
                if out is not None and out.num_rows:
                    yield out
    return df.select(*columns).mapInArrow(run, schema)


def bands_of(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges whose sizes sum to ``limit`` at most (one row at least)."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += int(n)
    if len(sizes) > start:
        yield start, len(sizes)
