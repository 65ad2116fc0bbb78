"""A corpus pipeline of five stages, each by an operator of meridian.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents. No stage swallows errors.

1. toxicity: documents that score 0.3 or more go. 2. quality: documents that score under 0.3 go. Both learn from the
labels outside the operators' held-out folds. 3. near_dedup: of documents that link by a Jaccard similarity of 0.8 or
more on five-word shingles, one stays; operator 8's fingerprints link first, prefixes find what they do not reach. 4. secrets: spans found are replaced in the text, and n_chars follows. 5. packing: pieces of token windows.
Null texts count as empty. An empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm import near_copies, packing, quality, secrets, toxicity
from meridian.llm.common import checkpointed, discarded, fresh, table

LIMIT = 0.3
#: The packing shares its executors with the other stages, so its cache of words is small.
CACHE_BYTES = 48 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(docs, model) < LIMIT)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(docs, weights) >= LIMIT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.distinct_documents(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spans = fresh(docs, "__spans")
    masked = secrets.redact(secrets.scan(docs, spans_col=spans), spans_col=spans)
    return masked.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(spans)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, cache_bytes=CACHE_BYTES).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_dedup", near_dedup),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: The classifiers, the tokenizer and the packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the table documents; each stage's rows are written between."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, docs = docs, checkpointed(stage(spark, docs, sf_dir))
        discarded(last)
    return STAGES[-1][1](spark, docs, sf_dir)
