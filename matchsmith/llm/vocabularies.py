"""Chunk encoders for public vocabularies of the sentencepiece and tokenizers libraries."""

from __future__ import annotations

import json
import os
import re
import string
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from matchsmith.llm.chunk_table import ChunkEncoder, ChunkTable, flatten, gather
from matchsmith.llm.common import text_bytes, worker_state

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARK = "▁"

# White space as either regex dialect sees it (Unicode White_Space and the four separators).
_SPACE = "\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_MIDDLE_SPACE = f"[{_SPACE}] [{_SPACE}]"


def _before_space(col: pa.Array) -> pa.Array:
    return pc.replace_substring(col, " ", "\x00 ")


class PieceVocabulary:
    """A sentencepiece model: exact encoding by marked words, decoding by piece texts.

    Whitespace runs are markers. If no piece holds a marker after another character, a marked
    word (run of markers and the characters after it) is segmented apart from its neighbours; a
    model for which that does not hold, or which normalises, is encoded text by text.
    """

    def __init__(self, model: bytes):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb
        self.sp = spm.SentencePieceProcessor(model_proto=model)
        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm, train = proto.normalizer_spec, proto.trainer_spec
        kinds = pb.ModelProto.SentencePiece.Type
        self.eos, self.bos = self.sp.eos_id(), self.sp.bos_id()
        crossing = any(MARK in p.piece.lstrip(MARK) for p in proto.pieces)
        user = any(p.type == kinds.USER_DEFINED for p in proto.pieces)
        self.by_word = (norm.name == "identity" and norm.add_dummy_prefix and not norm.precompiled_charsmap
                        and not norm.remove_extra_whitespaces and not train.treat_whitespace_as_suffix
                        and norm.escape_whitespaces and not crossing and not user and train.model_type == train.BPE)
        self.is_byte = np.array([p.type == kinds.BYTE for p in proto.pieces])
        self.is_unknown = np.array([p.type == kinds.UNKNOWN for p in proto.pieces])
        texts = ["" if p.type == kinds.CONTROL else p.piece.replace(MARK, " ") for p in proto.pieces]
        self.texts = pa.array(texts, pa.string())
        self.encoder = ChunkEncoder(ChunkTable(self._segment), self._cut, "  |^ ", self._careful)

    def _segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # a chunk is a run of spaces and a word; the library itself adds the first marker
        got = self.sp.encode([c[1:] for c in chunks], num_threads=1)
        return flatten([self._space if c == " " else g for c, g in zip(chunks, got)])

    @property
    def _space(self) -> list[int]:
        return [self.sp.piece_to_id(MARK)]

    @staticmethod
    def _cut(col: pa.Array) -> pa.Array:
        marked = pc.binary_join_element_wise(" ", pc.replace_substring(col, MARK, " "), "")
        # a text is led by one marker: its first chunk has no cut before it
        cut = pc.utf8_slice_codeunits(_before_space(marked), 1)
        return pc.if_else(pc.equal(col, ""), "", cut)

    @staticmethod
    def _careful(text: str) -> list[str]:
        return re.findall(r" *[^ ]+| +$", " " + text.replace(MARK, " ")) if text else []

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number by row), without end ids."""
        if not self.by_word:
            return flatten(self.sp.encode(pc.fill_null(col, "").to_pylist(), num_threads=1))
        return self.encoder.encode(pc.replace_substring(pc.fill_null(col.cast(pa.string()), ""), MARK, " "))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of rows of ids; rows with byte or unknown pieces go through the library."""
        pieces = self.texts.take(pa.array(ids))
        out = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pieces), "")
        # the first marker is the encoder's own
        out = pc.if_else(pc.starts_with(out, " "), pc.utf8_slice_codeunits(out, 1), out)
        special = (self.is_byte | self.is_unknown)[ids] if len(ids) else np.empty(0, bool)
        seen = np.concatenate([[0], np.cumsum(special)])
        rows = np.flatnonzero(seen[offsets[1:]] > seen[offsets[:-1]])
        if len(rows):
            fixed = out.to_pylist()
            for r in rows:
                fixed[r] = self.sp.decode(ids[offsets[r]:offsets[r + 1]].tolist())
            out = pa.array(fixed, pa.string())
        return out


# Unknown words that the library gets as one text.
WORDS_OF_A_TEXT = 1000

_PUNCTUATION = string.punctuation.replace("'", "")


class JsonVocabulary:
    """A tokenizers file (byte-level BPE, or BPE with word ends that drops white space).

    A text may be cut before a space unless white space stands on both sides of it: the
    pre-tokenizers take such a space with the word after it, or drop it. A word's trailing
    punctuation is a pre-token of its own, so letters are segmented once for all endings. Unknown
    words of letters, each a pre-token, are handed to the library many to a text, and the ids are
    dealt back by the bytes that they spell, or by the ids that end words. Special strings in a text
    get their own ids, as the library's default has it.
    """

    def __init__(self, definition: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(definition.decode("utf-8"))
        spec = json.loads(definition)
        self.size = self.tok.get_vocab_size()
        kinds = json.dumps([spec.get("pre_tokenizer"), spec.get("normalizer")])
        # added tokens are matched before any cut, so texts that hold one are not cut
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        plain = not any(t["normalized"] and spec.get("normalizer") for t in spec.get("added_tokens") or [])
        self.drops_space = '"Removed"' in kinds
        self.lowers = '"Lowercase"' in kinds
        self.by_word = plain and spec["model"]["type"] == "BPE" and '"add_prefix_space": true' not in kinds and (
            self.drops_space or (spec.get("normalizer") is None and '"use_regex": true' in kinds))
        model, self.bytes_of, self.ends_word = spec["model"], None, None
        ids, pieces = np.array(list(model["vocab"].values())), list(model["vocab"])
        if self.by_word and self.drops_space and model.get("end_of_word_suffix"):
            self.ends_word = np.zeros(self.size, bool)
            self.ends_word[ids] = [p.endswith(model["end_of_word_suffix"]) for p in pieces]
        elif self.by_word and not self.drops_space:  # a character of a piece stands for a byte
            self.bytes_of = np.zeros(self.size, np.int64)
            self.bytes_of[ids] = [len(p) for p in pieces]
        self.words = ChunkTable(self._split_words)
        self.parts = ChunkTable(self._segment)
        self.encoder = ChunkEncoder(self.words, _before_space, None if self.drops_space else _MIDDLE_SPACE,
                                    self._careful)

    def _segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        col = pa.array(chunks, pa.string())
        if self.ends_word is not None:
            plain = pc.and_(pc.utf8_is_alpha(col), pc.invert(pc.match_substring(col, "\u0130")))
        elif self.bytes_of is not None:
            plain = pc.and_(pc.starts_with(col, " "), pc.utf8_is_alpha(pc.utf8_slice_codeunits(col, 1)))
        else:
            return self._one_by_one(chunks)
        plain = plain.to_numpy(zero_copy_only=False).astype(bool)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n = int(plain.sum())
        groups = [[chunks[i] for i in order[at:min(at + WORDS_OF_A_TEXT, n)]] for at in range(0, n, WORDS_OF_A_TEXT)]
        encoded = self.tok.encode_batch_fast([("" if self.ends_word is None else " ").join(g) for g in groups], add_special_tokens=False)
        parts = [self._dealt(g, np.array(e.ids, np.int32)) for g, e in zip(groups, encoded)]
        parts.append(self._one_by_one([chunks[i] for i in order[n:]]))
        flat, lens = (np.concatenate(c) for c in zip(*parts))
        back = np.empty(len(chunks), np.int64)
        back[order] = np.arange(len(chunks))
        return gather(flat, (np.cumsum(lens) - lens)[back], lens[back]), lens[back]

    def _dealt(self, words: list[str], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that were encoded as one text, and their number by word."""
        if self.ends_word is not None:
            last = np.flatnonzero(self.ends_word[ids])
            fits = len(last) == len(words)
        else:
            stop, wanted = np.cumsum(self.bytes_of[ids]), np.cumsum(text_bytes(pa.array(words, pa.string())))
            last = np.searchsorted(stop, wanted)
            fits = last[-1] < len(stop) and bool((stop[last] == wanted).all())
        return (ids, np.diff(last, prepend=-1)) if fits else self._one_by_one(words)

    def _one_by_one(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flatten([e.ids for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)])

    def _careful(self, text: str) -> list[str]:
        return [c for c in re.split(r"(?<=\S)(?= \S)", text) if c]

    def _split_words(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks by their letters and their trailing punctuation."""
        whole = pa.array(chunks, pa.string())
        stem = pc.ascii_rtrim(whole, characters=_PUNCTUATION)
        letters = pc.if_else(pc.starts_with(stem, " "), pc.utf8_slice_codeunits(stem, 1), stem)
        split = pc.utf8_is_alpha(letters)
        if self.lowers:  # the one letter whose lower case holds a mark
            split = pc.and_(split, pc.invert(pc.match_substring(letters, "\u0130")))
        heads = letters if self.drops_space else stem
        heads = pc.if_else(split, pc.ascii_lower(heads) if self.lowers else heads, whole)
        split = split.to_numpy(zero_copy_only=False).astype(bool)
        size = text_bytes(whole)
        tail = np.where(split, size - text_bytes(stem), 0)
        stop = np.cumsum(size)
        spelt = gather(np.frombuffer("".join(chunks).encode(), np.uint8), stop - tail, tail)
        tails = pa.StringArray.from_buffers(len(chunks), pa.py_buffer(np.concatenate([[0], np.cumsum(tail)]).astype(np.int32)), pa.py_buffer(spelt))
        both = pa.concat_arrays([heads, tails]).dictionary_encode()
        ids, start, lens = self.parts.ids_of(both.dictionary)
        at = both.indices.to_numpy().reshape(2, -1).T.ravel()  # head, tail, head, tail, ...
        lens = lens[at].astype(np.int64)
        return gather(ids, start[at], lens), lens[::2] + lens[1::2]

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number by row), without end ids."""
        if not self.by_word:
            return self._one_by_one(pc.fill_null(col, "").to_pylist())
        col = pc.fill_null(col.cast(pa.string()), "")
        holds = np.zeros(len(col), bool)
        for content in self.added:
            holds |= pc.match_substring(col, content).to_numpy(zero_copy_only=False).astype(bool)
        if not holds.any():
            return self.encoder.encode(col)
        ids, lens = self.encoder.encode(pc.if_else(pa.array(holds), "", col))
        whole, sizes = self._one_by_one(col.filter(pa.array(holds)).to_pylist())
        # the others' ids keep their order; a row held back has none among them
        total = lens.astype(np.int64)
        total[holds] = sizes
        out, ours = np.empty(int(total.sum()), np.int32), np.repeat(holds, total)
        out[ours], out[~ours] = whole, ids
        return out, total


def vocabulary(kind: type, blob: bytes, name: str):
    """The vocabulary object of this worker process, built once."""
    held = worker_state().setdefault("vocabularies", {})
    key = (kind.__name__, name, len(blob))
    if key not in held:
        held[key] = kind(blob)
    return held[key]


def with_ends(ids: np.ndarray, lens: np.ndarray, end: int | None, begin: int | None = None):
    """Add a begin and an end id to each row; returns (ids, offsets)."""
    extra = (end is not None) + (begin is not None)
    stop = np.cumsum(lens + extra)
    offsets = np.concatenate([[0], stop]).astype(np.int64)
    out = np.empty(int(offsets[-1]), np.int32)
    body = np.ones(len(out), bool)
    if end is not None:
        body[stop - 1] = False
        out[stop - 1] = end
    if begin is not None:
        body[offsets[:-1]] = False
        out[offsets[:-1]] = begin
    out[body] = ids
    return out, offsets
