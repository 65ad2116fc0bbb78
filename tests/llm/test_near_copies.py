import random

import pytest
from conftest import prose

from meridian.llm import near_copies, simhash


def brute_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def brute_roots(texts):
    sets, root = [brute_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(sets)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) > 0:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in range(len(sets))}


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("size,often", [(3, 3), (40, 3), (40, 10**9)])
def test_one_stays_of_each_component_of_similar_pairs(spark, size, often, monkeypatch):
    monkeypatch.setattr(near_copies, "OFTEN", often)
    rng = random.Random(size)
    bases = [prose(s, rng.choice([8, 40, 200, 900])) for s in range(120 // size)]
    texts = [edited(rng, b, rng.randrange(1 + len(b.split()) // 30)) for b in bases for _ in range(size)] + ["", " ", "one two", "One two", "one two three", "a b c d e", "a b c d e f"]
    texts += [prose(999, 60) + " " + prose(1000 + i, 12) for i in range(20)]
    rng.shuffle(texts)
    want = brute_roots(texts)
    assert 10 < len(want) < len(texts) - 10
    got = near_copies.distinct_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == want


def test_stage_drops_a_near_copy_whose_fingerprint_is_far(spark):
    import corpus_pipeline
    from meridian.llm.simhash import fingerprint

    a = prose(5, 60)
    b = next(x for x in (edited(random.Random(s), a, 1) for s in range(1000)) if bin((fingerprint(a) ^ fingerprint(x)) & (1 << 64) - 1).count("1") > 2)
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [1]


def test_edge_rows(edge, nothing):
    rows = near_copies.distinct_documents(edge)
    assert rows.columns == edge.columns
    texts = [r.text for r in rows.collect()]
    assert sum(t in (None, "", " ", "\n\n") for t in texts) == 1 and sum(t == "one" for t in texts) == 1 and "null id" in texts
    assert near_copies.distinct_documents(nothing).collect() == []


def test_frequent_passages_move_back(spark, monkeypatch):
    """A passage that many texts share leaves their prefixes, neighbours in the text too, and the result stays."""
    passage = prose(7, 60)
    texts = [f"{prose(100 + i, 12)} {passage} {prose(300 + i, 3)}" for i in range(60)] + [f"{passage} w{i}" for i in range(3)]
    rows = near_copies.known(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    found = near_copies.checkpointed(near_copies.prints(rows, (near_copies.np.zeros(0, "i8"), near_copies.np.zeros(0, "i8"))))
    nodes = near_copies.checkpointed(found.groupBy("fp").agg(*(near_copies.F.first(c).alias(c) for c in ("hash", "n", "prefix", "counts"))))
    before = max(r.rows for r in near_copies._counted(nodes.select(near_copies.F.explode("prefix").alias("s"))).collect())
    none = near_copies.np.zeros(0, "i8")
    _, twice = near_copies.settled(nodes, rows, (none, none))
    assert before > 30 > 10 >= max((r.rows for r in twice.collect()), default=0)
    got = near_copies.distinct_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == brute_roots(texts)


def far_apart(a, b):
    return bin((a ^ b) & (1 << 64) - 1).count("1")


def test_fingerprints_link_and_their_links_are_verified(spark, monkeypatch):
    """Without any prefix, what operator 8 links within two bits is linked still, if the sets are similar."""
    print_of = lambda t: simhash.fingerprint(t, near_copies.WIDTH)
    a = prose(5, 900)
    near = next(x for x in (edited(random.Random(s), a, 1) for s in range(1000)) if 0 < far_apart(print_of(a), print_of(x)) <= 2)
    again, tails = " ".join(["a b c d e"] * 30), [prose(70, 10), prose(71, 10)]
    other = [f"{again} {t}" for t in tails]
    assert print_of(other[0]) == print_of(other[1]) and len(brute_roots(other)) == 2
    places = near_copies.shared_places
    monkeypatch.setattr(near_copies, "shared_places", lambda *x: places(*x).where("false"))
    got = near_copies.distinct_documents(spark.createDataFrame(list(enumerate([a, near, *other])), "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == {0, 2, 3}
    assert simhash.majority([near_copies.sequence(a)[:500], near_copies.sequence(a)[500:]]) == print_of(a)


@pytest.mark.parametrize("many", [0, 4])
def test_candidates_of_a_large_group_stay_in_proportion(spark, many, monkeypatch):
    """Near copies of one text, changed at one to eight places: compared with the least changed one, not with each other."""
    monkeypatch.setattr(near_copies, "MANY", many, raising=False)
    rng, base = random.Random(3), prose(50, 150)
    texts = [base, *(edited(rng, base, 1 + i % 8) for i in range(400))]
    seen, verified = [], near_copies.verified

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(near_copies, "verified", counted)
    got = near_copies.distinct_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == brute_roots(texts)
    assert sum(seen) < 8 * len(texts), seen
