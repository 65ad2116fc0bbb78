import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from meridian.llm import simhash


def brute_print(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes, most=2):
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    codes = sorted(codes)
    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= most:
                root[find(b)] = find(a)
    return {c: find(c) for c in codes}


def test_fingerprints(edge):
    got = sorted((str(r.doc_id), r.fp & (1 << 64) - 1) for r in simhash.fingerprints(edge.drop("fp"), ["doc_id"]).collect())
    assert got == sorted((str(r.doc_id), brute_print(r.text)) for r in edge.collect())


def groups(rng, n_groups, size, flips):
    out = set()
    for _ in range(n_groups):
        base = int(rng.integers(0, 1 << 62))
        for _ in range(size):
            code = base
            for b in rng.choice(64, flips, replace=False):
                code ^= 1 << int(b)
            out.add(code)
    return [c - (1 << 64) if c >> 63 else c for c in out]


@pytest.mark.parametrize("n_groups,size,flips,bucket", [(40, 5, 2, 64), (3, 60, 1, 8), (2, 80, 3, 8), (300, 1, 1, 64), (1, 1, 1, 64)])
def test_links(spark, n_groups, size, flips, bucket, monkeypatch):
    codes = groups(np.random.default_rng(size), n_groups, size, flips)
    nodes = simhash.checkpointed(spark.createDataFrame([(c,) for c in codes], "fp long"))
    stars = {r.u: r.v for r in simhash.components(simhash.links(nodes, bucket=bucket)).collect()}
    want = brute_components(codes)
    least = {}
    for c, r in want.items():
        least[r] = min(c, least.get(r, c))
    assert {c: stars.get(c, c) for c in codes} == {c: least[r] for c, r in want.items()}


def test_thresholds_cover_all_pairs():
    rng = np.random.default_rng(0)
    for total in (10, 10**5, 10**9):
        plan = simhash.plan(rng.integers(-(2**63), 2**63 - 1, 2000), total)
        assert sorted(b for g, _ in plan for b in g) == list(range(64)) and sum(t for _, t in plan) == 2 - len(plan) + 1


def test_documents(edge, nothing):
    rows = simhash.distinct_documents(edge)
    assert rows.columns == edge.columns
    texts = [r.text for r in rows.collect()]
    assert sum(t == "one" for t in texts) == 1 and sum(t in (None, "", " ", "\n\n") for t in texts) == 1 and "null id" in texts
    kept = {r.doc_id for r in rows.collect()}
    prints = {r.doc_id: brute_print(r.text) for r in edge.where("doc_id IS NOT NULL").collect()}
    comps = brute_components(set(prints.values()))
    assert len(kept - {None}) == len({comps[p] for p in prints.values()})
    assert simhash.distinct_documents(nothing).collect() == []


def test_null_ids_do_not_name_a_class(spark):
    df = spark.createDataFrame([(None, 0), (5, 1), (None, 1 << 40)], "id long, fp long")
    got = {r.fp: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert got == {0: 5, 1: 5, 1 << 40: 5}
    assert {r.fp: r.component_id for r in simhash.near_duplicates(df.where(F.col("id").isNull() & (F.col("fp") > 0))).collect()} == {1 << 40: None}


def test_other_thresholds_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), most=3)
