"""SentencePiece, Huffman files and packing against their libraries and brute force."""
import hashlib
import heapq
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matchsmith.llm import huffman, packing, pieces, queries
from matchsmith.llm.chunk_table import ChunkTable
from matchsmith.llm.common import Scratch, vocabulary_path
from matchsmith.llm.vocabularies import JsonVocabulary, PieceVocabulary

ALPHABET = ["a", "b", " ", "  ", "   ", "\n", "\t", "▁", "é", " ", "　", "\x1c", "\x00", "'s", "'", "1", "23", ".", ",", "%%%",
            "😀", "Σ", "İ", "字", "A", "the", "\r\n", " \n ", "<|endoftext|>", "</s>", "_", "-", "​"]


def fuzz(n=3000, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25))) for _ in range(n)] + ["", None, " ", "▁"]


def rows_of(ids, lens):
    at = np.concatenate([[0], np.cumsum(lens)])
    return [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])]


@pytest.fixture(scope="module")
def piece():
    return PieceVocabulary(open(vocabulary_path(pieces.MODEL), "rb").read())


@pytest.mark.parametrize("name", [huffman.VOCABULARY, packing.VOCABULARY])
def test_chunked_ids_equal_the_library(name):
    v = JsonVocabulary(open(vocabulary_path(name), "rb").read())
    assert v.by_word
    texts = fuzz()
    want = [e.ids for e in v.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert rows_of(*v.encode(pa.array(texts))) == want


def test_piece_ids_and_decoding_equal_the_library(piece):
    assert piece.by_word
    texts = fuzz()
    got = rows_of(*piece.encode(pa.array(texts)))
    assert got == piece.sp.encode([t or "" for t in texts])
    ids = [g + [piece.eos] for g in got]
    flat = np.array([i for g in ids for i in g], np.int32)
    offsets = np.concatenate([[0], np.cumsum([len(g) for g in ids])]).astype(np.int64)
    assert piece.decode(flat, offsets).to_pylist() == [piece.sp.decode(g) for g in ids]


@pytest.mark.parametrize("name", [huffman.VOCABULARY, packing.VOCABULARY])
def test_many_new_words_equal_the_library(name):
    """Words that go to the library many to a text, of several alphabets, with and without a space."""
    rng = random.Random(8)
    letters = ["abcdefgh", "äöüßéÀ", "αβγΣς", "жзий", "字漢語", "한글", "İıſ", "ﬁﬂ", "नमस्ते"]
    words = ["".join(rng.choice(a) for _ in range(rng.randint(1, 9))) for a in letters for _ in range(400)]
    rng.shuffle(words)
    texts = [" ".join(w + rng.choice(["", ",", "...", "'s", "-x", "7"]) for w in words[i:i + 40]) for i in range(0, len(words), 40)]
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(vocabulary_path(name))
    v = JsonVocabulary(open(vocabulary_path(name), "rb").read())
    assert rows_of(*v.encode(pa.array(texts))) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_full_chunk_table_keeps_the_most_used():
    asked = []
    table = ChunkTable(lambda xs: asked.extend(xs) or (np.array([ord(x) for x in xs], np.int32), np.ones(len(xs), np.int64)), limit=8)
    for word in ("ab", "ab", "abc", "def", "gh", "ij", "ab"):
        ids, start, lens = table.ids_of(pa.array(list(word)))
        assert [chr(ids[s]) for s in start] == list(word) and (lens == 1).all() and len(table.h0) <= 8
    assert asked.count("a") == asked.count("b") == 1


def test_full_chunk_table_keeps_ids():
    table = ChunkTable(lambda xs: (np.array([ord(x) for x in xs], np.int32), np.ones(len(xs), np.int64)), limit=3)
    for word in ("ab", "cd", "ea", "abcde", "xyz"):
        ids, start, lens = table.ids_of(pa.array(list(word)))
        assert [chr(ids[s]) for s in start] == list(word) and (lens == 1).all()
        assert len(table.h0) <= 5


def test_sentencepiece_operator(awkward, no_documents, piece):
    rows = {(r["doc_id"], tuple(r["ids"])) for r in pieces.encode(awkward).collect()}
    want = {(r["doc_id"], tuple(piece.sp.encode(r["text"] or "") + [piece.eos])) for r in awkward.collect()}
    assert rows == want
    back = {(r["doc_id"], r["text"]) for r in pieces.decode(pieces.encode(awkward)).collect()}
    assert back == {(d, piece.sp.decode(list(i))) for d, i in want}
    assert pieces.encode(no_documents).count() == 0


def test_op2_query(spark, small, piece):
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas().set_index("doc_id")["text"]
    for r in queries.op2_sentencepiece(spark, small).collect():
        ids = piece.sp.encode(docs[r["doc_id"]]) + [piece.eos]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(piece.sp.decode(ids).encode()).hexdigest()


def plain_huffman_bits(counts):
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        total += s
        heapq.heappush(heap, s)
    return total


def test_code_lengths():
    counts = np.random.default_rng(0).zipf(1.4, 2000)
    counts = np.where(counts < 1 << 40, counts, 1)
    lengths = huffman.code_lengths(counts, 40)
    assert (counts * lengths).sum() == plain_huffman_bits(counts)
    for bits in (11, 12, 16):
        short = huffman.code_lengths(counts, bits)
        assert short.max() <= bits and sum(2.0 ** -short.astype(float)) == 1.0
        assert (counts * short).sum() >= (counts * lengths).sum()
    assert huffman.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]
    assert huffman.code_lengths(np.array([0, 0])).tolist() == [0, 0]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(100, np.int64), 6)


def test_length_limit_is_optimal():
    from itertools import product
    rng = np.random.default_rng(3)
    for _ in range(10):
        counts = np.sort(rng.integers(1, 200, 5))
        best = min((counts * np.array(ls)).sum() for ls in product(range(1, 4), repeat=5) if sum(2.0 ** -x for x in ls) <= 1)
        assert (counts * huffman.code_lengths(counts, 3)).sum() == best


def test_blocks_decode_from_checkpoints():
    rng = np.random.default_rng(1)
    lens = np.array([0, 1, 700, 3, 256, 257, 0, 512])
    ids = (rng.zipf(1.5, lens.sum()) % 300).astype(np.int32)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=300))
    codes = huffman.canonical_codes(lengths)
    offsets = np.concatenate([[0], np.cumsum(lens)])
    words, first, at = huffman.pack_rows(ids, offsets, lengths, codes)
    begin, sizes = huffman.stretches(lens)
    starts = at[begin]
    raw = huffman.block_bytes(np.arange(8), np.zeros(8, bool), lens, starts, words.astype("<u8").tobytes())
    table = huffman.decode_table(lengths)
    keys, null, back, got = huffman.read_block(raw, table)
    assert back.tolist() == ids.tolist() and got.tolist() == lens.tolist() and keys.tolist() == list(range(8))
    padded = np.concatenate([words, np.zeros(2, np.uint64)])
    one = huffman.unpack_bits(padded, starts[3:4], sizes[3:4], table)  # a stretch by itself
    assert one.tolist() == ids[begin[3]:begin[3] + sizes[3]].tolist()


def test_token_files(spark, awkward, no_documents):
    folder = Scratch(spark, "test").path("files")
    blocks = huffman.store_ids(awkward, folder)
    assert blocks.agg(F.sum("n_rows")).head()[0] == awkward.count()
    v = JsonVocabulary(open(vocabulary_path(huffman.VOCABULARY), "rb").read())
    texts = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in awkward.collect()))
    got = sorted(huffman.read(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [i if held else None for held, i, _ in texts]
    at = 0
    for r, (_, _, t) in zip(got, texts):
        ids = v.tok.encode(t, add_special_tokens=False).ids + [2]
        assert r["start"] == at and np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids
        at += len(ids)
    empty = Scratch(spark, "test").path("none")
    huffman.store_ids(no_documents, empty)
    assert huffman.read(spark, empty).count() == 0


def test_op5_query(spark, small):
    v = JsonVocabulary(open(vocabulary_path(huffman.VOCABULARY), "rb").read())
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in queries.op5_token_files(spark, small).collect()}
    at = 0
    for d in docs:
        ids = v.tok.encode(d["text"], add_special_tokens=False).ids + [2]
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("seed,n,low,high", [(0, 3000, 1, 64), (1, 500, 20, 64), (2, 40, 1, 5), (3, 5000, 10, 40), (4, 1, 64, 64)])
def test_plan_places_every_piece(seed, n, low, high):
    lengths = np.random.default_rng(seed).integers(low, high + 1, n)
    counts = np.bincount(lengths, minlength=65)
    slots, sequences = packing.plan(counts, 64)
    fill = np.zeros(sequences, int)
    used = {}
    for length, rank, ranks, per, first, offset in slots.tolist():
        assert ranks % per == 0
        used.setdefault(length, []).append((rank, ranks))
        fill[first:first + ranks // per] += per * length
    for length, spans in used.items():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert sum(n for _, n in spans) == counts[length]
    assert fill.max() <= 64 and fill.sum() == lengths.sum()
    assert sequences <= np.ceil(lengths.sum() / 64) * 1.05 + 1 or low > 16


def test_least_squares_repeats():
    counts = np.zeros(65, np.int64)
    counts[[40, 24, 32]] = [1000, 1000, 500]
    patterns = packing.exact_patterns(counts, 64)
    assert sorted(map(tuple, patterns.tolist())) == [(32, 32, 0), (40, 24, 0)]
    assert np.allclose(sorted(packing.fit_repeats(patterns, counts)), [250, 1000])
    assert packing.plan(counts, 64)[1] == 1250


def test_packing(spark, awkward, no_documents, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 2)  # several buckets a length
    table = Scratch(spark, "test").table(packing.pieces(awkward), "pieces")
    placed = packing.pack(table, order=["doc_id", "piece", "ids"])
    rows = placed.collect()
    v = JsonVocabulary(open(vocabulary_path(packing.VOCABULARY), "rb").read())
    want = []
    for r in awkward.collect():
        ids = v.tok.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want += [(r["doc_id"] or -1, k // 4096, k, tuple(ids[k:k + 4096])) for k in range(0, len(ids), 4096)]
    got = [(r["doc_id"] or -1, r["piece"], r["start"], tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist())) for r in rows]
    assert sorted(got) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= 4096
    whole = {r["sequence_id"]: len(r["ids"]) // 4 for r in packing.sequences(placed).collect()}
    assert whole == {s: sum(n for _, n in spans) for s, spans in by.items()}
    empty = Scratch(spark, "test").table(packing.pieces(no_documents), "pieces")
    assert packing.pack(empty).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(5000,)], "length long"))


def test_op9_query(spark, small):
    rows = queries.op9_packing(spark, small).toPandas()
    assert rows["sequence_id"].nunique() <= np.ceil(rows["length"].sum() / 4096) * 1.02 + 1
    v = JsonVocabulary(open(vocabulary_path(packing.VOCABULARY), "rb").read())
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas().set_index("doc_id")["text"]
    for r in rows.itertuples():
        ids = (v.tok.encode(docs[r.doc_id], add_special_tokens=False).ids + [1])[r.start:r.start + r.length]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32 and r.start == 4096 * r.piece


@pytest.mark.parametrize("name", [huffman.VOCABULARY, packing.VOCABULARY])
def test_special_strings_have_the_librarys_ids(name):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(vocabulary_path(name))
    v = JsonVocabulary(open(vocabulary_path(name), "rb").read())
    texts = ["one document ends. <|endoftext|> the next", "<|endoftext|>", "a<|endoftext|>b", "<|startoftext|>Word, <|endoftext|><|endoftext|>.",
             "no such string", "(<|endoftext|>)!", "  <|endoftext|>  x", "<|ENDOFTEXT|>", "<|endoftext", None, ""] + fuzz()
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert rows_of(*v.encode(pa.array(texts))) == want
    assert max(want[0]) == tok.token_to_id("<|endoftext|>")


def test_special_strings_in_token_files_and_packing(spark):
    from tokenizers import Tokenizer
    texts = {1: "one document ends. <|endoftext|> the next", 2: "<|endoftext|>", 3: "plain words"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    folder = Scratch(spark, "special").path("files")
    huffman.store_ids(docs, folder)
    tok = Tokenizer.from_file(vocabulary_path(huffman.VOCABULARY))
    rows = {r["doc_id"]: r["ids"] for r in huffman.read(spark, folder).collect()}
    for i, t in texts.items():
        assert np.frombuffer(bytes(rows[i]), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids + [2]
    tok = Tokenizer.from_file(vocabulary_path(packing.VOCABULARY))
    for r in packing.pieces(docs).collect():
        assert r["length"] == len(tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids) + 1
