"""Operator 3: sum-of-squares packing of tokenized documents into windows.

Online, for each document in turn: its full windows are cut off first; the rest goes to the fill level at which the
sum over all levels of the squared number of partially filled windows comes out least (a new window is one of the
choices). An array holds the number of windows at each level, so a placement is one pass over the levels. When a
partition's documents are placed, what is left in its partial windows is cut to fill them one after another, and
the last one is cut into windows whose lengths are powers of two, which need no padding.

Each partition of the input packs by itself: nothing is shuffled, and a lost task packs the same rows again. Null
texts count as empty and consist of the end token alone. Rows, repeated ones too, are packed one for one. Each token
lies in exactly one piece. A partition's partial windows are held in memory, at most (capacity - 1) tokens for each of
them. An empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from meridian.llm.common import quoted, small_batches, tidy, whole_text
from meridian.llm.tokens import CACHE_BYTES, LONGEST_KEY, Memo, mapped, vocabulary

VOCABULARY = "word_bpe_49k.json"
CAPACITY, END = 4096, 2

#: Fixed value: how this vocabulary splits a text before its merges.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters whose normal form and lower case are the same by every version of Unicode.
_PLAIN = regex.compile(r"[\x21-\x7E\xA1-įı-ɏ]*")
_PLAIN_TEXT = re.compile(r"[\t\n\r\x20-\x7E\xA1-įı-ɏ]*")
#: Characters of texts that are split together, and words that the library gets in one string.
GROUP, TOGETHER = 1 << 18, 128
_BLANK = mapped(b" ")


class Words:
    """Token ids by the tokenizers library, each blank-delimited word encoded once by a worker.

    The vocabulary drops white space and never joins what it parts, so a text's ids are those of its words, unless
    it holds a special token's string; such a text goes to the library whole, as does a word with unusual characters.
    Texts without unusual characters are normalised whole, and the words of several that the cache lacks are merged together."""

    def __init__(self, path: str, cache_bytes: int = 2 * CACHE_BYTES):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = regex.compile("|".join(regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.word = Memo(self._word, cache_bytes)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.merges = Tokenizer(self.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        suffix = self.model.end_of_word_suffix
        ids = {i: bool(suffix) and t.endswith(suffix) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.last = np.zeros(max(ids, default=0) + 1, bool)  # tokens that end a word
        self.last[[i for i, ends in ids.items() if ends]] = True

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            low = word.lower()
        elif _PLAIN.fullmatch(word):
            low = unicodedata.normalize("NFC", word).lower()
        else:
            return self._whole(word)
        parts = [low] if low.isalpha() else SPLIT.findall(low)
        if parts == [word]:  # one that the merges start from
            return array("I", [t.id for t in self.model.tokenize(mapped(word.encode()))]).tobytes()
        return b"".join(map(self.word.__getitem__, parts))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> np.ndarray:
        raw = self._whole(text) if self.special.search(text) else b"".join(map(self.word.__getitem__, text.replace("\n", " ").split(" ")))
        return np.frombuffer(raw, "<u4")

    def ids_of(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """ids() of each text."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP:
                yield from self._together(group)
                group, size = [], 0
        yield from self._together(group)

    def _together(self, texts: list[str]) -> Iterator[np.ndarray]:
        plain = [not self.special.search(t) and bool(_PLAIN_TEXT.fullmatch(t)) for t in texts]
        parted = [unicodedata.normalize("NFC", t).lower().split() if p else [] for t, p in zip(texts, plain, strict=True)]
        found = [[*map(self.word.get, parts)] for parts in parted]
        self._learn({w for parts, ids in zip(parted, found, strict=True) for w, x in zip(parts, ids, strict=True) if x is None})
        for text, p, parts, ids in zip(texts, plain, parted, found, strict=True):
            yield np.frombuffer(b"".join([x if x is not None else self.word[w] for w, x in zip(parts, ids, strict=True)]), "<u4") if p else self.ids(text)

    def _learn(self, lowered: set[str]) -> None:
        """Puts normalised plain words into the cache; long ones it does not keep anyway."""
        lowered = [w for w in lowered if len(w) <= LONGEST_KEY]
        parted = {w: SPLIT.findall(w) for w in lowered if not w.isalpha()}
        if self.word.room < 0:
            self.word.emptied()
        parts = {w for w in lowered if w not in parted}
        parts.update(x for x in set().union(*parted.values()) if x not in self.word)
        parts, strings = [*parts], []
        for at in range(0, len(parts), TOGETHER):
            s = " ".join(parts[at : at + TOGETHER])
            strings.append(s if s.isascii() else mapped(s.encode()).replace(_BLANK, " "))
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.merges.encode_batch_fast(strings, add_special_tokens=False)), "<u4")
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        if len(ends) != len(parts):  # a vocabulary that does not mark where words end
            return
        raw = ids.tobytes()
        self.word.keep({x: raw[start:end] for x, start, end in zip(parts, [0, *ends], ends)})
        self.word.keep({w: b"".join(map(self.word.__getitem__, own)) for w, own in parted.items() if own != [w]})


@cache
def words(path: str, cache_bytes: int = 2 * CACHE_BYTES) -> Words:
    return Words(path, cache_bytes)


class Packer:
    """Places documents; a piece is (document, start, ids), with the document as (id, number of tokens)."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # of partial windows, by level
        self.open: dict[int, list[list]] = {}  # partial windows by level

    def add(self, doc: tuple, ids: np.ndarray) -> Iterator[list[tuple]]:
        """Yields the windows that become full."""
        cut = len(ids) - len(ids) % self.capacity
        for at in range(0, cut, self.capacity):
            yield [(doc, at, ids[at : at + self.capacity])]
        size = len(ids) - cut
        if not size:
            return
        level = self.best(size)
        window = self.open[level].pop() if level else []
        self.count[level] -= level > 0
        window.append((doc, cut, ids[cut:]))
        if level + size == self.capacity:
            yield window
        else:
            self.count[level + size] += 1
            self.open.setdefault(level + size, []).append(window)

    def best(self, size: int) -> int:
        """The level (0: a new window) at which the squares grow least; of equal ones the fullest."""
        n, last = self.count, self.capacity - size
        gain = 2 * (n[size : self.capacity + 1] - n[: last + 1]) + 2
        gain[0] = 2 * n[size] + 1
        gain[last] = 1 - 2 * n[last]  # a full window counts no more
        gain[1:][n[1 : last + 1] == 0] = np.iinfo(np.int64).max
        return last - int(np.argmin(gain[::-1]))

    def rest(self) -> Iterator[list[tuple]]:
        """Fills the partial windows with each other's pieces, then cuts the last by powers of two."""
        pieces = [p for level in sorted(self.open, reverse=True) for w in self.open[level] for p in w]
        left = sum(len(p[2]) for p in pieces)
        window, room = [], min(self.capacity, self._power(left))
        for doc, start, ids in pieces:
            while len(ids):
                n = min(room, len(ids))
                window.append((doc, start, ids[:n]))
                start, ids, room, left = start + n, ids[n:], room - n, left - n
                if not room:
                    yield window
                    window, room = [], min(self.capacity, self._power(left))

    @staticmethod
    def _power(n: int) -> int:
        return 1 << (n.bit_length() - 1) if n else 0


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end: int = END, cache_bytes: int = 2 * CACHE_BYTES) -> DataFrame:
    """(id, start, length, ids binary, doc_tokens, sequence_id, offset) of every piece; ids are little-endian unsigned 32-bit.

    `capacity` is a power of two. `cache_bytes` bounds a worker's cache of words, for speed alone. A sequence id is the partition's number times 2^33 plus the window's number in it."""
    path = path or vocabulary(VOCABULARY)
    rows = docs.select(F.col(quoted(id_col)).alias("id"), whole_text(text_col).alias("text"))
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, packer, sequence, out = words(path, cache_bytes), Packer(capacity), TaskContext.get().partitionId() << 33, []
        kind = None

        def put(windows: Iterator[list[tuple]]) -> None:
            nonlocal sequence
            for window in windows:
                offset = 0
                for doc, start, ids in window:
                    out.append((doc[0], start, len(ids), ids.tobytes(), doc[1], sequence, offset))
                    offset += len(ids)
                sequence += 1

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            kinds = [kind, *[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 3]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for b in small_batches(batches):
            kind = b.schema.field("id").type
            for doc_id, ids in zip(b.column("id").to_pylist(), w.ids_of(b.column("text").to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                put(packer.add((doc_id, len(ids)), ids))
            if out:
                yield batch()
        for window in packer.rest():
            put([window])
            if len(out) >= 2000:
                yield batch()
        if out:
            yield batch()

    return rows.mapInArrow(tidy(run), f"id {rows.schema['id'].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
