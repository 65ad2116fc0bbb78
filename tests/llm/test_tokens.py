import base64
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meridian.llm import bpe_codec, packing, token_counts

PATH = public_tokenizers.path


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(PATH("byte_bpe_50k.json")), Tokenizer.from_file(PATH("word_bpe_49k.json"))


def test_codec_counts_and_round_trip(edge, reference):
    want, library, _ = reference
    rows = bpe_codec.decode(bpe_codec.encode(edge)).collect()
    counts = token_counts.count_tokens(edge).collect()
    texts = [(r.doc_id, r.text or "") for r in edge.collect()]
    assert sorted((str(r.id), list(r.ids), bytes(r.decoded)) for r in rows) == sorted((str(i), want.encode_ordinary(t), t.encode()) for i, t in texts)
    assert sorted((str(r.id), r.n_bytes, r.n_tokens) for r in counts) == sorted((str(i), len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\tab'.,!?1é 　日🙂ſ\x1cZ"), max_size=40) | st.text(max_size=30))
def test_any_text(reference, text):
    want, library, words = reference
    codec = bpe_codec.codec(PATH("byte_bpe_50k.tiktoken"))
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert codec.encode(text).tolist() == want.encode_ordinary(text) and codec.decode(codec.encode(text)) == text.encode()
    assert token_counts.counter(PATH("byte_bpe_50k.json")).count(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert packing.words(PATH("word_bpe_49k.json")).ids(text).tolist() == words.encode(text, add_special_tokens=False).ids


def test_words_of_plain_texts_are_merged_together(reference, monkeypatch):
    """one call of the library for many words, at whatever group and with a cache that empties again and again."""
    syllables = ["an", "thé", "Ion", "ou", "ß", "x1", "don't", "e.", ",", "Ǆ", "½", "--"]
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice([*syllables, " ", " ", "\n", "\t"], 400)) for _ in range(60)]
    odd = ["", "İstanbul \x00 日本", "stop <|endoftext|> now", "x" * 3000 + " a", "nbsp\xa0here \u2003 é", "ΣΑΣ K"]
    want = [reference[2].encode(t, add_special_tokens=False).ids for t in texts + odd]
    for group, room in ((1 << 18, 1 << 24), (1000, 20_000)):
        monkeypatch.setattr(packing, "GROUP", group)
        w = packing.Words(PATH("word_bpe_49k.json"), room)
        alone = []
        w.word.compute = lambda word, w=w, alone=alone: alone.append(word) or w._word(word)
        assert [x.tolist() for x in w.ids_of(texts + odd)] == want
        if room > 1 << 20:
            words = {x for t in texts for x in t.lower().split()}
            assert len(alone) < 20 < len(words) and not words & set(alone)


def test_multilingual_vocabulary(spark):
    df = spark.createDataFrame([(1, "über größe naïve 日本")], "doc_id long, text string")
    path = PATH("byte_bpe_multi_50k.tiktoken")
    r = bpe_codec.decode(bpe_codec.encode(df, path=path), path=path).first()
    assert bytes(r.decoded).decode() == "über größe naïve 日本"


def test_decoding_of_odd_ids(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [464, -5, 10**8, None])], "id long, ids array<int>")
    assert [bytes(r.decoded) for r in bpe_codec.decode(df).collect()] == [b"", b"", b"The"]


def check_packing(pieces, docs, capacity=packing.CAPACITY):
    """docs: (id, ids) with the end id. Every id once, windows gapless, short ones powers of two."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault((p.id, p.doc_tokens), []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
        assert len(p.ids) == 4 * p.length
    for key in {(i, len(x)) for i, x in docs}:
        want = sorted(np.asarray(x, "<u4").tobytes() for i, x in docs if (i, len(x)) == key)
        parts = sorted(by_doc[key], key=lambda p: p.start)
        assert sum(p.length for p in parts) == key[1] * len(want)
        if len(want) == 1:
            assert b"".join(bytes(p.ids) for p in parts) == want[0] and [p.start for p in parts] == np.cumsum([0, *(p.length for p in parts)])[:-1].tolist()
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p.offset)
        ends = np.cumsum([p.length for p in parts]).tolist()
        assert [p.offset for p in parts] == [0, *ends[:-1]] and ends[-1] <= capacity and ends[-1] & (ends[-1] - 1) == 0


def test_packing(edge, reference):
    pieces = packing.pack(edge).collect()
    check_packing(pieces, [(r.doc_id, [*reference[2].encode(r.text or "", add_special_tokens=False).ids, 2]) for r in edge.collect()])
    assert zlib.crc32(np.array([2], "<u4").tobytes()) in {zlib.crc32(bytes(p.ids)) for p in pieces}


def brute_level(count, size, capacity):
    """The level whose squares grow least, by squaring all of them for each choice."""
    best = None
    for level in range(capacity - size + 1):
        if level and not count[level]:
            continue
        after = dict(enumerate(count))
        after[level] -= level > 0
        if level + size < capacity:
            after[level + size] += 1
        total = sum(after[h] ** 2 for h in range(1, capacity))
        if best is None or (total, -level) < best:
            best = (total, -level)
    return -best[1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_sum_of_squares(sizes):
    p, windows = packing.Packer(16), []
    for i, n in enumerate(sizes):
        rest = n % 16
        if rest:
            assert p.best(rest) == brute_level(p.count[:17].tolist(), rest, 16)
        windows += p.add((i, n), np.arange(n, dtype="<u4"))
    windows += p.rest()
    assert sum(len(x[2]) for w in windows for x in w) == sum(sizes)
    assert sum(sum(len(x[2]) for x in w) < 16 for w in windows) <= 4 and all((n := sum(len(x[2]) for x in w)) <= 16 and n & (n - 1) == 0 for w in windows)


def test_empty_tables(nothing):
    assert bpe_codec.decode(bpe_codec.encode(nothing)).collect() == token_counts.count_tokens(nothing).collect() == packing.pack(nothing).collect() == []
