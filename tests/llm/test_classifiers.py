import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.llm import quality, toxicity
from meridian.llm.common import labelled_sample

WORDS = "river stone winter candle garden window letter bridge market summer forest paper silver harbor morning mountain shadow valley".split()
RUDE = ["moronic", "scumbag", "worthless"]


def text_of(rng, rude=False, junk=False):
    words = [rng.choice(WORDS) for _ in range(rng.randint(15, 60))]
    if rude:
        for _ in range(3):
            words.insert(rng.randrange(len(words)), rng.choice(RUDE))
    if junk:
        words = [w + rng.choice(["***", "$$$"]) for w in words]
    return " ".join(words)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(600):
        toxic, good = int(i % 6 == 0), int(i % 5 != 0)
        docs.append((i, text_of(rng, toxic, not good), "x"))
        labels.append((i, good, toxic))
    docs += [(600, None, "x"), (601, "", "x"), (None, "river stone", "x"), (3, docs[3][1], "x"), (602, "y" * 50_000, "x")]
    labels += [(None, 1, 1), (700, 1, 0), (5, None, None), (3, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, label string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held_out(labels, modulus, fold, name):
    return {r.doc_id: r[name] for r in labels.collect() if r.doc_id is not None and r[name] is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == fold}


def test_quality(tables):
    docs, labels = tables
    weights = quality.train(docs, labels)
    scores = {r.doc_id: r.s for r in docs.select("doc_id", quality.score(docs, weights).alias("s")).collect()}
    want = held_out(labels.where("doc_id < 600"), 5, 0, "quality")
    assert sum((scores[i] >= 0.3) == bool(y) for i, y in want.items()) >= 0.97 * len(want)
    assert 0 <= scores[600] <= 1 and scores[600] == scores[601]


def test_toxicity(tables):
    docs, labels = tables
    model = toxicity.train(docs, labels)
    assert {t for t, _ in model["terms"]} >= {"worthless"}
    scores = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.score(docs, model).alias("s")).collect()}
    want = held_out(labels.where("doc_id < 600"), 4, 2, "toxic")
    assert all((scores[i] >= 0.3) == bool(y) for i, y in want.items())
    assert scores[600] == scores[601] < 0.3


def test_labels_do_not_leak(tables, spark):
    docs, labels = tables
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.train(docs, labels) == quality.train(docs.repartition(5), turned)).all()


def test_without_labels(tables, spark):
    docs, labels = tables
    none = labels.where("false")
    assert {round(r[0], 6) for r in docs.select(quality.score(docs, quality.train(docs, none))).collect()} == {0.5}
    assert max(r[0] for r in docs.select(toxicity.score(docs, toxicity.train(docs, none))).collect()) < 0.3
    assert docs.where("false").select(quality.score(docs, quality.train(docs.where("false"), labels))).collect() == []


def test_sample_is_bounded_and_one_for_an_id(tables):
    docs, labels = tables
    rows = labelled_sample(docs, labels, "quality", F.lit(True), 50).collect()
    assert len(rows) == 50 and len({r.doc_id for r in rows}) == 50


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def test_automaton_equals_distances():
    rng = random.Random(2)
    terms = [("idiot", False), ("worthless", False), ("scum", False), ("lowei", True), ("disgusting", False)]
    match = toxicity.Matcher(terms)
    for _ in range(4000):
        word = list(rng.choice(terms)[0] + rng.choice(["", "", "ab", "x"]))
        for _ in range(rng.randint(0, 3)):
            kind, at = rng.randint(0, 2), rng.randrange(len(word) + 1)
            word[at : at + (kind > 0)] = [rng.choice("abcdeilorstw")] if kind < 2 else []
        word = "".join(word)
        whole = min((d for t, b in terms if not b and (d := distance(t, word)) <= toxicity.edits_for(t)), default=None)
        stem = min((d for t, b in terms if b for n in range(len(word) + 1) if (d := distance(t, word[:n])) <= toxicity.edits_for(t)), default=None)
        want = 0 if whole is None and stem is None else 1 + 2 * (whole > 0) if stem is None or whole is not None and whole <= stem else 2 + 2 * (stem > 0)
        assert match(word) == want, word


def test_context_tells_quotation_from_abuse():
    scorer = toxicity.Scorer({"terms": [("idiot", False)], "clean": {"idiom"}, "weights": toxicity.PRIOR})
    plain, quoted, told, address = scorer("you are an idiot today"), scorer('the word "idiot" is old'), scorer("he said idiot once"), scorer('you "idiot" go away')
    assert plain > 0.5 > quoted and told < 0.5 and address > quoted
    assert scorer("an idi0t") > 0.3 and scorer("an idiom here") < 0.3 and scorer("") < 0.3


def test_ftrl_learns_a_line():
    w = quality.fit([("good fine", 1)] * 50 + [("bad poor", 0)] * 50)
    f = quality.Features()
    p = [quality.sigmoid(w[at] @ x) for at, x in (f("good fine"), f("bad poor"))]
    assert p[0] > 0.8 and p[1] < 0.2 and np.count_nonzero(w) < 40


def test_ftrl_equals_plain_python():
    """FTRL-proximal with dictionaries, coordinate by coordinate and pass by pass."""
    from math import exp, log, sqrt

    rng = random.Random(3)
    rows = [(text_of(rng, junk=i % 2), 1 - i % 2) for i in range(30)] + [("", 1), ("a a a", 0), ("same text", 0), ("same text", 1)]
    features, z, n, last = quality.Features(), {}, {}, float("inf")
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= quality.L1 else ((quality.L1 if z[i] > 0 else -quality.L1) - z[i]) / ((quality.BETA + sqrt(n[i])) / quality.ALPHA + quality.L2)
    while True:
        loss = 0.0
        for text, y in rows:
            pairs = [(int(i), float(v)) for i, v in zip(*features(text))]
            w = {i: weight(i) for i, _ in pairs}
            p = 1 / (1 + exp(-sum(w[i] * v for i, v in pairs)))
            loss -= log(p if y else 1 - p)
            before = {i: n.get(i, 0.0) for i in w}
            for i, v in pairs:
                g = (p - y) * v
                step = (sqrt(before[i] + g * g) - sqrt(before[i])) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - step * w[i]
                n[i] = n.get(i, 0.0) + g * g
        if last - loss / len(rows) < quality.GAIN:
            break
        last = loss / len(rows)
    got = quality.fit(rows)
    assert {i: pytest.approx(weight(i), rel=1e-4, abs=1e-5) for i in z if weight(i)} == {int(i): float(got[i]) for i in np.flatnonzero(got)}


def test_shapes_are_whole():
    assert quality.shape("ab-1-." * 9) != quality.shape("ab-1-." * 10) and quality._codes("ab-1-." * 9) >> 32 != quality._codes("ab-1-." * 10) >> 32


def brute_toxic(text, model):
    """Every word by edit distances, every hit by its own context."""
    counts = [0] * 9
    lower = text.lower()
    inside = lambda at, end: any(m.start() < at and end < m.end() for m in toxicity.QUOTED.finditer(text))
    for m in toxicity.WORD.finditer(lower):
        w = m[0]
        whole = min((d for t, b in model["terms"] if not b and (d := distance(t, w)) <= toxicity.edits_for(t)), default=None)
        stem = min((d for t, b in model["terms"] if b for k in range(len(w) + 1) if (d := distance(t, w[:k])) <= toxicity.edits_for(t)), default=None)
        if whole is None and stem is None:
            continue
        kind = 1 + 2 * (whole > 0) if stem is None or whole is not None and whole <= stem else 2 + 2 * (stem > 0)
        if kind > 2 and w in model["clean"]:
            continue
        near = [x.lower() for x in toxicity.WORD.findall(text[max(0, m.start() - 40) : m.start()])[-4:] + toxicity.WORD.findall(text[m.end() : m.end() + 40])[:3]]
        quoted = inside(*m.span()) + any(x in toxicity.REPORTING for x in near) - any(x in toxicity.ADDRESS for x in near) > 0
        counts[2 * kind - (not quoted)] += 1
    x = np.array([1.0, *(np.log2(1 + c) for c in counts[1:])])
    return 1 / (1 + np.exp(-(x @ model["weights"])))


def test_score_equals_plain_python():
    rng = random.Random(8)
    model = {"terms": [("idiot", False), ("worthless", False), ("lowei", True)], "clean": {"idiom"}, "weights": toxicity.PRIOR}
    pool = ["idiot", "idiot5", "idi0t", "idiom", "worthles", "loweiter", '"', "\n", "you", "said", "river", "“", "”", "stone"]
    scorer = toxicity.Scorer(model)
    for _ in range(300):
        text = " ".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))
        assert scorer(text) == pytest.approx(brute_toxic(text, model), abs=1e-12), text


def test_hits_are_all_counted():
    scorer = toxicity.Scorer({"terms": [("idiot", False)], "clean": set(), "weights": toxicity.PRIOR})
    assert scorer("you idiot5") == scorer("you idiot") > 0.8
    assert scorer.features("you idiot " * 9)[1] == pytest.approx(np.log2(10)) and scorer.features("idiot " * 30)[1] > scorer.features("idiot " * 9)[1]
    quote = '"' + "so many words come before it in the very same sentence that ends in an idiot" + ' and goes on for a while longer than forty characters" he wrote'
    assert scorer.features(quote)[2] == 1
    assert scorer.features('the "first" quotation; a plain idiot; the "second"')[1] == 1


def test_sample_is_bounded_in_bytes(tables):
    docs, labels = tables
    few = quality.train(docs, labels, sample_bytes=2000)
    assert 0 < np.count_nonzero(few) < np.count_nonzero(quality.train(docs, labels))
