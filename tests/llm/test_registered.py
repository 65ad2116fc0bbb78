"""The registered queries' own columns, held against the public libraries and brute force on the smallest tables."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from test_near_copies import brute_roots
from test_secrets import brute
from test_secrets_battery import brute_spans
from tokenizers import Tokenizer

import corpus_pipeline
from meridian.llm import quality, queries, secrets, toxicity
from meridian.llm.common import checkpointed, table


def rows(spark, sf, name):
    return queries.queries()[name](spark, sf).collect()


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}


def sha(x):
    return hashlib.sha256(x).hexdigest()


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op1(spark, sf):
    vectors = {r.vec_id: np.asarray(r.embedding, float) for r in table(spark, sf, "embeddings").collect() if r.embedding is not None}
    ids = np.array(sorted(vectors))
    unit = np.stack([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    found: dict = {}
    for r in rows(spark, sf, "op1_hilbert_neighbours"):
        found.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        c = unit @ unit[np.searchsorted(ids, q)]
        c[ids == q] = -2
        best = {int(i) for i in ids[np.lexsort((ids, -np.round(c, 14)))[:5]]}
        got = sorted(found[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] and all(abs(r.score - c[np.searchsorted(ids, r.vec_id)]) < 1e-12 for r in got)
        hits, total = hits + len(best & {r.vec_id for r in got}), total + 5
    assert hits >= 0.9 * total


def test_op2(spark, sf, texts):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(spark, sf, "op2_bpe_codec")
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(texts[r.doc_id].encode()))


def check_pieces(pieces, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs, windows = {}, {}
    for p in pieces:
        docs.setdefault(p.doc_id, []).append(p)
        windows.setdefault(p.sequence_id, []).append(p)
    assert docs.keys() == texts.keys()
    for i, own in docs.items():
        ids, at = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 2], "<u4"), 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert (p.ids_crc32 if hasattr(p, "ids_crc32") else zlib.crc32(p.ids)) == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for own in windows.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        size = sum(p.length for p in own)
        assert size <= 4096 and size & (size - 1) == 0


def test_op3(spark, sf, texts):
    check_pieces(rows(spark, sf, "op3_packing"), texts)


def test_op6(spark, sf, texts):
    got = {r.doc_id: r for r in rows(spark, sf, "op6_secret_scan")}
    order = sorted(texts)
    for i, spans in zip(order, brute_spans([texts[i] for i in order]), strict=True):
        base = brute(texts[i])
        written = lambda found: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in found)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert got[i].base_sha256 == sha(written(base).encode()) and got[i].spans == written(spans)


def test_op7_and_op10(spark, sf, texts):
    for name, n, held, train, scorer in (("op7_quality", 5, 0, quality.train, None), ("op10_toxicity", 4, 2, toxicity.train, toxicity.Scorer)):
        docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
        model = train(docs, labels, folds=n, held_out=held)
        if scorer:
            score = scorer(model)
        else:
            features = quality.Features()
            score = lambda t: (lambda at, x: 1 / (1 + np.exp(-float(sum(model[i] * v for i, v in zip(at, x, strict=True))))))(*features(t))  # noqa: B023, E731
        got = rows(spark, sf, name)
        assert len(got) == len(texts)
        for r in got:
            assert r.held_out == (fold(r.doc_id, n) == held) and r.predicted == int(r.score >= 0.3) and r.score == pytest.approx(score(texts[r.doc_id]), abs=1e-6)


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({i: " " for i in range(9, 14)}).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def test_op8(spark, sf, texts):
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(texts):
        for j in sorted(texts):
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, sf, "op8_simhash")}
    assert got == {i: (f"{prints[i]:016x}", find(i)) for i in texts}


def test_op9(spark, sf, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows(spark, sf, "op9_token_counts"):
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


def test_pipeline_on_edge_rows_equals_plain_python(spark, sf, edge):
    """Every stage's rows on nulls, empty and long texts, repeats, null ids and clashing names, each on what the last one kept."""
    docs, labels = edge.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), table(spark, sf, "labels")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        after = checkpointed(stage(spark, docs, sf))
        got = {r.doc_id: r for r in after.collect()}
        if name == "toxicity":
            score = toxicity.Scorer(toxicity.train(docs, labels))
            want = {i for i, r in before.items() if score(r.text or "") < 0.3}
        elif name == "quality":
            w, features = quality.train(docs, labels), quality.Features()
            want = {i for i, r in before.items() if (lambda at, x: quality.sigmoid(float(w[at] @ x)))(*features(r.text or "")) >= 0.3}
        elif name == "near_dedup":
            ids = sorted(before)
            want = {ids[k] for k in brute_roots([before[i].text or "" for i in ids])}
        elif name == "secrets":
            want = set(before)
            spans = brute_spans([before[i].text or "" for i in sorted(before)])
            assert all(got[i].text == before[i].text for i, s in zip(sorted(before), spans, strict=True) if not s)
        else:
            check_pieces(after.collect(), {i: r.text or "" for i, r in before.items()})
            want = set(before)
        assert set(got) == want and (name == "packing" or after.columns == docs.columns), name
        docs = after
    assert len(want) > 5
