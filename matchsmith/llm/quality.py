"""Quality rules from tokeniser fertility.

A public vocabulary was fitted on ordinary prose, so text that it cuts into unusually short,
repetitive or byte-level pieces is unlike prose: symbol noise, shouting, tables, binary debris.
Per document: characters per token, share of byte-fallback pieces, and entropy of its tokens.
Each is held against a band of the document's language (or, without one, its script) and
length class. The script is that of most of its letters, by code points; a text without letters
takes that of its language, or of the corpus, and has no vote in bands. Bands come from all distinct texts that pass the base rules, one vote a text however
many copies it has: the median less or plus
so many spreads, the spread being the upper half's, which junk on the low side doesn't widen.
Groups of under ``MIN_GROUP`` texts use the band of all lengths of their language and script, then
those of their script. No band of another script rejects a text: one whose script has under
``MIN_GROUP`` texts is judged by the base rules alone, unless it is the corpus's most frequent script.

Base measures take words ``[^\\x20\\x09-\\x0D]+``. Null texts have no words. Empty tables give
empty results; repeated rows give repeated results. Columns besides the named ones aren't read.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchsmith.llm.common import Scratch, map_texts, read_bytes, texts_of, vocabulary_path
from matchsmith.llm.vocabularies import PieceVocabulary, vocabulary
from matchsmith.operators.joins import bounded_broadcast

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODEL = "piece_bpe_32k.model"
MIN_GROUP = 30
# Spreads below and above the median at which a measure is out of its band, and least spreads.
BANDS = {"chars_per_token": (3.5, 12.0, 0.05), "token_entropy": (3.0, 12.0, 0.08), "byte_share": (None, 12.0, 0.01)}

_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"


def _byte_flags() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    symbol, space, first = np.zeros(256, np.int8), np.zeros(256, np.int8), np.ones(256, np.int8)
    symbol[[ord(c) for c in _SYMBOLS]] = 1
    space[[ord(c) for c in _SPACES]] = 1
    first[0x80:0xC0] = 0
    return symbol, first * (1 - space), first


@cache
def _script_runs() -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(first code points of runs, their scripts' numbers, names); number 0 is no script. Names are
    first words of letters' names; kana count as Han, since Japanese text mixes them."""
    starts, codes, names = [0], [0], [""]
    merged = {"CJK": "HAN", "HIRAGANA": "HAN", "KATAKANA": "HAN", "KATAKANA-HIRAGANA": "HAN"}
    for cp in range(0x110000):
        c, code = chr(cp), 0
        # modifier letters, letter-like symbols, ordinals and mathematical alphabets are of no script
        if (unicodedata.category(c)[0] == "L" and cp not in (0xAA, 0xB5, 0xBA)
                and not any(a <= cp <= b for a, b in ((0x2B0, 0x2FF), (0x2100, 0x214F), (0x1D400, 0x1D7FF), (0x1EE00, 0x1EEFF)))):
            words = unicodedata.name(c, "UNNAMED").split()  # Tangut
            name = words[words[0] in ("FULLWIDTH", "HALFWIDTH")].split("-")[0]
            name = merged.get(name, name)
            if name not in names:
                names.append(name)
            code = names.index(name)
        if code != codes[-1]:
            starts.append(cp)
            codes.append(code)
    return np.array(starts), np.array(codes), names


def _scripts(raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, codes: np.ndarray, n_scripts: int) -> np.ndarray:
    """Number of the script of most letters of each row of UTF-8; 0 without letters."""
    n = len(offsets) - 1
    ascii_letter = np.zeros(256, np.int8)
    ascii_letter[[*range(65, 91), *range(97, 123)]] = 1
    at = np.flatnonzero(raw >= 0xC0)  # first bytes of longer characters
    b = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int32)
    b0, b1, b2, b3 = b[at], b[at + 1] & 63, b[at + 2] & 63, b[at + 3] & 63
    cp = np.where(b0 < 0xE0, (b0 & 31) << 6 | b1,
                  np.where(b0 < 0xF0, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3))
    code = codes[np.searchsorted(starts, cp, "right") - 1]
    rows = np.searchsorted(offsets, at, "right") - 1
    counts = np.bincount(rows * n_scripts + code, minlength=n * n_scripts).reshape(n, n_scripts)
    counts[:, codes[np.searchsorted(starts, 65, "right") - 1]] += _row_sums(ascii_letter[raw], offsets)
    counts[:, 0] = 0
    return counts.argmax(1)


def _row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(codes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Words by row that stand in a three-word window found twice or more in their row."""
    if len(codes) < 3:
        return np.zeros(n, np.int64)
    width = int(codes.max()) + 1
    pairs = codes[:-1].astype(np.int64) * width + codes[1:]
    if width >= 1 << 21:  # three codes don't fit one word: rename the pairs first
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    keys = pairs[:-1] * width + codes[2:]
    inside = np.flatnonzero(rows[:-2] == rows[2:])
    keys = keys[inside]
    order = np.argsort(keys, kind="stable")  # equal windows of a row end up side by side
    k, r = keys[order], rows[inside][order]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    starts = inside[order[twice]]
    held = np.zeros(len(codes), bool)
    for d in range(3):
        held[starts + d] = True
    return np.bincount(rows[held], minlength=n)


def _duplicate_lines(col: pa.Array) -> np.ndarray:
    lists = pc.split_pattern(col, "\n")
    rows = np.repeat(np.arange(len(col)), np.diff(lists.offsets.to_numpy()))
    lines = lists.values
    worded = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False).astype(bool)
    codes = lines.dictionary_encode().indices.to_numpy()[worded].astype(np.int64)
    rows = rows[worded]
    distinct = np.unique((rows.astype(np.int64) << 32) | codes) >> 32
    return np.bincount(rows, minlength=len(col)) - np.bincount(distinct, minlength=len(col))


def _entropy(ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Bits of the token distribution of each row."""
    rows = np.repeat(np.arange(len(lens), dtype=np.int64), lens)
    keys, counts = np.unique((rows << 32) | ids, return_counts=True)
    row = keys >> 32
    p = counts / np.maximum(lens, 1)[row]
    return np.bincount(row, weights=-p * np.log2(p), minlength=len(lens)) + 0.0


def measures(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = "lang",
             model: str | None = None) -> DataFrame:
    """Base measures and fertility of each row's whole text."""
    path = model or vocabulary_path(MODEL)
    blob = df.sparkSession.sparkContext.broadcast(read_bytes(df.sparkSession, path))
    kind = df.schema[key].dataType.simpleString()
    symbol, worded, first = _byte_flags()
    starts, codes_of, scripts = _script_runs()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_tokens", "n_bytes"]

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(PieceVocabulary, blob.value, path)
        col = texts_of(part.column(1))
        n = len(col)
        offsets = np.frombuffer(col.buffers()[1], np.int32, n + 1, col.offset * 4).astype(np.int64)
        raw = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        offsets -= offsets[0]
        lists = pc.ascii_split_whitespace(col)
        words = lists.values.dictionary_encode()
        rows = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
        real = pc.not_equal(lists.values, "").to_numpy(zero_copy_only=False).astype(bool)
        codes, rows = words.indices.to_numpy()[real], rows[real]
        ids, lens = v.encode(col)
        at = np.concatenate([[0], np.cumsum(lens)])
        got = [np.bincount(rows, minlength=n), _row_sums(worded[raw], offsets), _row_sums(symbol[raw], offsets),
               _duplicate_lines(col), _repeats(codes, rows, n), _row_sums(first[raw], offsets), lens,
               _row_sums(v.is_byte[ids], at)]
        cols = [part.column(0), pc.fill_null(part.column(2).cast(pa.string()), "")] + [pa.array(g.astype(np.int64)) for g in got]
        return pa.RecordBatch.from_arrays(cols + [pa.array(_entropy(ids, lens)), part.column(3),
                                           pa.array(scripts, pa.string()).take(pa.array(_scripts(raw, offsets, starts, codes_of, len(scripts))))],
                                          [key, "lang", *names, "token_entropy", "text_hash", "script"])

    schema = f"`{key}` {kind}, lang string, " + ", ".join(f"{c} long" for c in names) + ", token_entropy double, text_hash long, script string"
    chosen = df.select(key, text, (F.col(lang) if lang and lang in df.columns else F.lit(None).cast("string")).alias("_lang"),
                       F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash"))
    out = map_texts(chosen, [key, text, "_lang", "_hash"], text, schema, step)
    return out.withColumns({
        "chars_per_token": F.col("n_chars") / F.greatest(F.col("n_tokens"), F.lit(1)),
        "byte_share": F.col("n_bytes") / F.greatest(F.col("n_tokens"), F.lit(1)),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })


def bands(rows: DataFrame) -> DataFrame:
    """Bands by language, script and length class, one row a group: ``level`` 0 lang, script and
    size_class, 1 lang and script, 2 script and size_class, 3 script. Of ``n`` texts each, which
    ``verdicts`` holds against ``MIN_GROUP``."""
    good = (rows.filter(~F.col("base_failed") & (F.col("script") != "")).withColumn("size_class", _size_class())
            .groupBy("lang", "script", "text_hash").agg(F.min("size_class").alias("size_class"), *[F.min(m).alias(m) for m in BANDS]))
    # a text that stands under several languages votes once in its script's bands
    texts = good.groupBy("script", "text_hash").agg(F.min("size_class").alias("size_class"), *[F.min(m).alias(m) for m in BANDS])
    quartiles = [F.percentile_approx(m, [0.5, 0.75], 1000).alias(m) for m in BANDS]

    def groups(of: DataFrame, keys: list[str], level: int) -> DataFrame:
        got = of.groupingSets([[*keys, "size_class"], keys], *keys, "size_class").agg(
            F.count(F.lit(1)).alias("n"), (F.grouping("size_class") + F.lit(level)).cast("int").alias("level"), *quartiles)
        lang = F.col("lang") if "lang" in keys else F.lit(None).cast("string").alias("lang")
        return got.select(lang, "script", "size_class", "n", "level", *BANDS)

    out = groups(good, ["lang", "script"], 0).unionByName(groups(texts, ["script"], 2))
    for m, (low, high, least) in BANDS.items():
        spread = F.greatest((F.col(m)[1] - F.col(m)[0]) / 0.6745, F.lit(least))
        out = out.withColumns({
            f"{m}_low": F.col(m)[0] - spread * F.lit(low) if low is not None else F.lit(float("-inf")),
            f"{m}_high": F.col(m)[0] + spread * F.lit(high)})
    return out.drop(*BANDS)


def _size_class():
    """Half octaves of the number of tokens."""
    return F.floor(2 * F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int")


def verdicts(rows: DataFrame, table: DataFrame, max_bands: int = 100_000) -> DataFrame:
    """Add ``kept``: not base_failed and every measure inside its band."""
    names = [f"{m}_{side}" for m in BANDS for side in ("low", "high")]
    by = {0: ["lang", "script", "size_class"], 1: ["lang", "script"], 2: ["script", "size_class"], 3: ["script"]}
    # the scripts that texts without letters take
    leading = table.filter("level = 1 and lang != ''").groupBy("lang").agg(F.max_by("script", F.struct("n", "script")).alias("__leading"))
    edge = table.filter("level = 3").orderBy(F.desc("n"), F.desc("script")).select("script").head()
    top = F.lit(edge[0] if edge else "")
    out = rows.withColumn("size_class", _size_class()).join(bounded_broadcast(leading, max_bands), ["lang"], "left")
    out = out.withColumn("script", F.when(F.col("script") != "", F.col("script")).otherwise(F.coalesce("__leading", top)))
    enough = F.col("n") >= MIN_GROUP
    for level, keys in by.items():
        fit = table.filter(F.col("level") == level).filter(enough | (F.col("script") == top) if level == 3 else enough)
        fit = fit.select(*keys, *[F.col(c).alias(f"__{level}_{c}") for c in names])
        out = out.join(bounded_broadcast(fit, max_bands), keys, "left")
    inside = ~F.col("base_failed")
    for m in BANDS:
        low, high = (F.coalesce(*[F.col(f"__{level}_{m}_{s}") for level in by]) for s in ("low", "high"))
        inside = inside & F.coalesce((F.col(m) >= low) & (F.col(m) <= high), F.lit(True))
    return out.withColumn("kept", inside).select(*[c for c in rows.columns if c not in ("text_hash", "script")], "kept")


def quality(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = "lang",
            model: str | None = None) -> DataFrame:
    """Measures and verdict of each row."""
    scratch = Scratch(df.sparkSession, "quality")
    rows = scratch.table(measures(df, key, text, lang, model), "measures")
    return verdicts(rows, scratch.table(bands(rows), "bands"))
