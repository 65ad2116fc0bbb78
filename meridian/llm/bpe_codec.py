"""Operator 2: byte-level BPE encoding and decoding through a sentencepiece model made from the vocabulary.

The rank file's tokens, their bytes written as printable characters, become the pieces of a BPE model whose scores
are the negative ranks; sentencepiece merges the pair with the best score first, which is the pair of least rank.
The normaliser is the identity. The model is serialised here, field by field; nothing is trained.

Null texts count as empty and give no ids. Rows, repeated ones too, are kept one for one; other columns are not
carried. A text of any length is encoded whole: the cost is linear in it but for runs without white space, which
sentencepiece merges with a heap. An empty table gives an empty one.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import quoted, small_batches, tidy, whole_text
from meridian.llm.tokens import Segments, byte_of, mapped, read_ranks, vocabulary

RANKS = "byte_bpe_50k.tiktoken"


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, raw: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(raw)) + raw


def _float(field: int, x: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", x)


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto with a piece for each token, in order of rank, and an unknown piece last."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    pieces = [_bytes(1, _bytes(1, mapped(t).encode()) + _float(2, -float(ranks[t]))) for t in tokens]
    unknown = _bytes(1, _bytes(1, b"<unk>") + _float(2, 0.0) + _number(3, 2))
    # Field numbers of sentencepiece_model.proto: model_type 3 (BPE is 2), vocab_size 4, then the ids of unk, bos, eos and pad.
    trainer = _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    # name 1, add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5
    normalizer = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + unknown + _bytes(2, trainer) + _bytes(3, normalizer)


class Codec:
    """Encodes and decodes by the model; one for each worker and vocabulary."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(self.ranks))
        tokens = sorted(self.ranks, key=self.ranks.__getitem__)
        self.rank_of_piece = [self.ranks[t] for t in tokens]
        back = byte_of()
        raw = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(tokens))]
        top = max(self.rank_of_piece, default=-1) + 1
        self.lengths = np.zeros(top + 1, np.int64)  # by rank; the last stands for ids that there are not
        self.lengths[self.rank_of_piece] = [len(x) for x in raw]
        self.starts = np.zeros(top + 1, np.int64)
        self.starts[self.rank_of_piece] = np.cumsum([0, *map(len, raw)])[:-1]
        self.pool = np.frombuffer(b"".join(raw), np.uint8)
        self.ranks_are_ids = self.rank_of_piece == list(range(len(tokens)))
        self.segments = Segments(self.pre_token, b"".join)
        self.ready: dict[str, bytes] = {}

    def prepare(self, texts: list[str]) -> None:
        """Encodes the texts' new words in one call, which is cheaper than one by one."""
        words = [w for w in self.segments.unseen(texts) if w.encode() not in self.ranks]
        self.ready = dict(zip(words, map(self._packed, self.model.encode([mapped(w.encode()) for w in words], num_threads=1)), strict=True))

    def _packed(self, ids: list[int]) -> bytes:
        return array("i", ids if self.ranks_are_ids else [self.rank_of_piece[i] for i in ids]).tobytes()

    def pre_token(self, word: str) -> bytes:
        """The ids of a pre-token as little-endian 32-bit numbers."""
        if (known := self.ready.get(word)) is not None:
            return known
        raw = word.encode("utf-8", "surrogatepass")
        if (rank := self.ranks.get(raw)) is not None:  # a pre-token that is a token stands whole
            return struct.pack("<i", rank)
        return self._packed(self.model.encode(mapped(raw)))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.segments.values(text)), "<i4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; ids that the vocabulary lacks stand for none."""
        ids = np.where((ids >= 0) & (ids < len(self.lengths) - 1), ids, len(self.lengths) - 1)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.pool[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def _numbers(ids: pa.ListScalar) -> np.ndarray:
    return np.empty(0, np.int32) if ids.values is None else ids.values.fill_null(-1).to_numpy(zero_copy_only=False)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every text."""
    path = path or vocabulary(RANKS)
    rows = docs.select(F.col(quoted(id_col)).alias("id"), whole_text(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in small_batches(batches):
            texts = b.column("text").to_pylist()
            c.prepare(texts)
            found = [c.encode(t) for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("id"), ids], ["id", "ids"])

    return rows.mapInArrow(tidy(run), f"id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(id, ids, decoded binary) of the rows of encode(); null ids decode to none."""
    path = path or vocabulary(RANKS)
    rows = encoded.select("id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in small_batches(batches):
            decoded = pa.array([c.decode(_numbers(x)) for x in b.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("ids"), decoded], ["id", "ids", "decoded"])

    return rows.mapInArrow(tidy(run), f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, decoded binary")
