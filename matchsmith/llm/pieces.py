"""SentencePiece encoding and decoding by a distinct-chunk table.

Pieces of the usual models never cross a whitespace marker, so a text is cut into marked words
(a run of markers and the characters after it). Each slice of rows is dictionary-encoded; every
distinct marked word is segmented once per worker (``ChunkTable``) and its ids are joined back
by position. Ids equal the library's for every text: a model whose pieces cross markers, or
that normalises, is encoded text by text.

Null texts count as empty and give the end id alone. Null keys are carried. Repeated rows give
repeated results. Empty tables give empty results. Only the named columns are read, so further
columns, whatever their names, don't matter.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from matchsmith.llm.common import map_texts, read_bytes, vocabulary_path
from matchsmith.llm.vocabularies import PieceVocabulary, vocabulary, with_ends

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODEL = "piece_bpe_32k.model"


def _loader(df: DataFrame, model: str | None):
    """The model's bytes (a public vocabulary file, a few MB at most) broadcast to the workers."""
    path = model or vocabulary_path(MODEL)
    blob = df.sparkSession.sparkContext.broadcast(read_bytes(df.sparkSession, path))
    return lambda: vocabulary(PieceVocabulary, blob.value, path)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None,
           add_end: bool = True, add_begin: bool = False) -> DataFrame:
    """``key`` and ``ids array<int>`` of each row's whole text."""
    load = _loader(df, model)
    kind = df.schema[key].dataType.simpleString()

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        v = load()
        ids, lens = v.encode(part.column(1))
        ids, offsets = with_ends(ids, lens, v.eos if add_end else None, v.bos if add_begin else None)
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
        return pa.RecordBatch.from_arrays([part.column(0), lists], [key, "ids"])

    return map_texts(df, [key, text], text, f"`{key}` {kind}, ids array<int>", step)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", model: str | None = None) -> DataFrame:
    """``key`` and ``text`` of each row's ids, as the library's decode gives it (null ids: empty)."""
    load = _loader(df, model)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        v = load()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                lists = part.column(1)
                offsets = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy())])
                texts = v.decode(lists.flatten().to_numpy(), offsets.astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), texts], [key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
