"""Token sets of long texts in a packed form: ``struct<n, packed>``, the number of tokens and their bytes.

A text's q-grams as an array of longs take four times the text, its words as an array of strings
twice: too much to go through joins with every pair. Packed, a set takes about a third of its text.
Sets are packed once an entity and met in pairs, both as Arrow-batched ``pandas_udf``s: sorted q-grams
as three planes of code points, words as they come, each compressed. Sizes and intersections are exact. The set of a
null text has null words and no q-grams.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as TY

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors have no copy of this package

SET = TY.StructType([TY.StructField("n", TY.LongType()), TY.StructField("packed", TY.BinaryType())])
CODE_BITS = 21
CODE_MASK = (1 << CODE_BITS) - 1


def qgram_codes(text: str) -> np.ndarray:
    """Sorted distinct 3-grams of a padded text, three code points a long (``similarity.qgram_codes``)."""
    u = np.frombuffer(f"##{text}$$".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.unique((u[:-2] << 2 * CODE_BITS) | (u[1:-1] << CODE_BITS) | u[2:])


def pack_codes(codes: np.ndarray) -> bytes:
    planes = np.stack([codes >> 2 * CODE_BITS, codes >> CODE_BITS & CODE_MASK, codes & CODE_MASK])
    width = np.min_scalar_type(int(planes.max())).itemsize
    return bytes([width]) + zlib.compress(planes.astype(f"<u{width}").tobytes(), 1)


def unpack_codes(packed: bytes) -> np.ndarray:
    c = np.frombuffer(zlib.decompress(packed[1:]), f"<u{packed[0]}").astype(np.int64).reshape(3, -1)
    return (c[0] << 2 * CODE_BITS) | (c[1] << CODE_BITS) | c[2]


def _qgram_set(text) -> tuple:
    if not text:
        return 0, b""
    codes = qgram_codes(text)
    return len(codes), pack_codes(codes)


def _word_set(text) -> tuple:
    if text is None:
        return None, None
    words = dict.fromkeys(text.split())
    return len(words), zlib.compress("\n".join(words).encode("utf-8", "surrogatepass"), 1)


def _common_codes(a: bytes, b: bytes) -> int:
    return len(np.intersect1d(unpack_codes(a), unpack_codes(b), assume_unique=True))


def _common_words(a: bytes, b: bytes) -> int:
    return len(set(zlib.decompress(a).split(b"\n")).intersection(zlib.decompress(b).split(b"\n")))


def _packer(of):
    def run(texts: pd.Series) -> pd.DataFrame:
        sets = [of(t) for t in texts]
        return pd.DataFrame({"n": pd.array([n for n, _ in sets], dtype="Int64"), "packed": [p for _, p in sets]})
    return F.pandas_udf(run, SET)


def _meeting(of):
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        rows = zip(a["n"], a["packed"], b["n"], b["packed"])
        return pd.Series([None if pd.isna(m) or pd.isna(n) else of(p, q) if m and n else 0 for m, p, n, q in rows], dtype="Int64")
    return F.pandas_udf(run, TY.LongType())


PACK = {"qg3": _packer(_qgram_set), "ws": _packer(_word_set)}
COMMON = {"qg3": _meeting(_common_codes), "ws": _meeting(_common_words)}
