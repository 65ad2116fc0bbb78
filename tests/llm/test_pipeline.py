import re

import pytest

import corpus_pipeline
from meridian.llm import queries
from meridian.llm.common import checkpointed, table
from meridian.llm.simhash import fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(sf):
    """The labels of the smallest tables are too few to learn from."""
    return sf.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    sf = sf_dir
    docs = table(spark, sf, "documents")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = checkpointed(stage(spark, docs, sf))
        out.append((name, docs))
    return dict(out)


def test_stages(stages, spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "secrets", "packing"]
    for name in ("toxicity", "quality", "near_dedup", "secrets"):
        assert stages[name].columns == COLUMNS
    counts = {n: df.count() for n, df in stages.items()}
    assert counts["documents"] > counts["toxicity"] > counts["quality"] >= counts["near_dedup"] == counts["secrets"] > 0
    labels = {r.doc_id: r for r in table(spark, sf_dir, "labels").collect()}
    kept = {r.doc_id for r in stages["quality"].collect()}
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert sum(i in kept for i in clean) >= 0.9 * len(clean)


def test_one_of_each_group_stays(stages):
    prints = [fingerprint(r.text or "") for r in stages["near_dedup"].collect()]
    before = {fingerprint(r.text or "") for r in stages["quality"].collect()}
    assert len(set(prints)) == len(prints) <= len(before)
    assert not any(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for i, a in enumerate(prints) for b in prints[i + 1 :])


def test_secrets_are_gone(stages):
    for r in stages["secrets"].collect():
        assert not re.search("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", r.text) and r.n_chars == len(r.text)


def test_all_kept_documents_are_packed(stages):
    pieces = stages["packing"].collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in stages["secrets"].collect()}
    sums: dict = {}
    for p in pieces:
        sums[p.sequence_id] = sums.get(p.sequence_id, 0) + p.length
    assert all(n & (n - 1) == 0 and n <= 4096 for n in sums.values())


def test_edge_rows_pass(spark, sf, edge, nothing):
    for docs in (edge, nothing):
        first = {r.doc_id for r in docs.collect()}
        for name, stage in corpus_pipeline.STAGES:
            docs = checkpointed(stage(spark, docs, sf))
        assert {r.doc_id for r in docs.collect()} <= first and docs.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered(name, spark, sf):
    tables = {"op1": "embeddings", "op4": "embeddings", "op5": "pages"}
    n = queries.queries()[name](spark, sf).count()
    if name.split("_")[0] in ("op2", "op5", "op6", "op7", "op8", "op9", "op10"):
        assert n == table(spark, sf, tables.get(name.split("_")[0], "documents")).count()
    else:
        assert n > 0


def test_names_that_helpers_might_take_stay(spark, sf):
    names = ["__id", "__kept", "__text_hash", "__rows", "__spans", "row", "hash", "text_", "copies", "its_id"]
    docs = spark.createDataFrame([(1, "a secret password=abcdef1 here", 0), (2, "other words entirely", 0), (2, "other words entirely", 1)], "doc_id long, text string, n_chars long").selectExpr("*", *(f"doc_id * 10 AS `{n}`" for n in names))
    kept = corpus_pipeline.mask_secrets(spark, corpus_pipeline.near_dedup(spark, docs, sf), sf)
    assert kept.columns == docs.columns
    got = sorted(kept.collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.n_chars) for r in got] == [(1, len("a secret [SECRET] here")), (2, 0)]  # of rows alike but for n_chars the first by JSON
    assert all(r[n] == r.doc_id * 10 for r in got for n in names)
