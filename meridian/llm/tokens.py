"""What the tokenizing operators share: vocabularies, the byte alphabet and a segmentation that caches can use."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import cache
from weakref import ref

import public_tokenizers
import regex

#: Bytes, as estimated, that a worker's cache of segments may take before it starts afresh.
CACHE_BYTES, LONGEST_KEY = 72 << 20, 1000

#: White space right before a blank or line break: there a cut at the second one would part a run of white space.
_RUN = re.compile(r"\s[ \n]")
#: A word of Latin letters with at most one mark after it.
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+([.,!?;:]|)")


@cache
def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


@cache
def byte_map() -> dict[int, str]:
    """byte_alphabet() for str.translate of a text decoded as Latin-1."""
    return dict(enumerate(byte_alphabet()))


def mapped(raw: bytes) -> str:
    return raw.decode("latin-1").translate(byte_map())


@cache
def byte_of() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_alphabet())}


@cache
def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file's tokens: base64 and rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; every worker has it, as it comes with an installed package."""
    return public_tokenizers.path(name)


@cache
def pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


class Memo(dict):
    """A dict from strings that computes what it lacks and starts afresh when it has `most` bytes; long keys it does not keep.

    An entry is estimated by its key: a dict's share and two objects' heads, and what key and value have for each character."""

    def __init__(self, compute: Callable, most: int = CACHE_BYTES):
        super().__init__()
        self.compute, self.room, self.most = compute, most, most
        _memos.append(ref(self))

    def __missing__(self, key):
        value = self.compute(key)
        if (n := len(key)) <= LONGEST_KEY:
            if self.room < 0:
                self.emptied()
            self.room -= 200 + 5 * n
            self[key] = value
        return value

    def keep(self, new: dict) -> None:
        """Takes in what was computed, all of it."""
        self.room -= 200 * len(new) + 5 * sum(map(len, new))
        self.update(new)

    def emptied(self) -> None:
        self.clear()
        self.room = self.most


_memos: list[ref] = []


def forget() -> None:
    """Empties all caches of this worker: other operators' tasks come after."""
    _memos[:] = [r for r in _memos if (m := r()) is not None and m.emptied() is None]


class Segments:
    """Maps a text to the values of its segments, each computed once.

    A match of the splitting pattern that holds a character other than white space ends before the next white
    space, so a text can be cut before each blank or line break that follows such a character, and each segment is
    split as it would be in the text. Where white space is followed by a blank or line break, the text is taken as
    one segment instead."""

    def __init__(self, pre_token: Callable[[str], object], total: Callable[[list], object]):
        """pre_token: a match's value; total: of several."""
        self.pre_token, self.total = pre_token, total
        self.match = Memo(pre_token)
        self.whole = Memo(self.value_of)
        self.after_blank = Memo(lambda word: self.value_of(" " + word))

    def value_of(self, segment: str):
        if m := _WORD.fullmatch(segment):  # one match or two, as the pattern has it
            return self.total([self.pre_token(segment[:-1]), self.match[m[1]]]) if m[1] else self.pre_token(segment)
        return self.total([self.match[x] for x in pattern().findall(segment)])

    def unseen(self, texts: list[str]) -> set[str]:
        """Pre-tokens, a blank and a word each, that values() would compute for these texts; not all of them."""
        words = set().union(*(t.replace("\n", " ").split(" ") for t in texts)) - self.after_blank.keys()
        return {" " + w[: m.start(1)] for w in words if (m := _WORD.fullmatch(w)) and w[0] != " "}

    def values(self, text: str) -> list:
        if _RUN.search(text):
            return [self.value_of(text)]
        out, lead, after = [], "", self.after_blank.__getitem__
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(self.whole[lead + first])
            out.extend(map(after, rest))
            lead = "\n"
        return out
