"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.llm.tokens import forget
from meridian.materialize import discarded, materialized as checkpointed

__all__ = ["checkpointed", "discarded", "fold_of", "fresh", "known", "labelled_sample", "quoted", "small_batches", "table", "tidy", "within_bytes", "whole_text"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """A text as it is; null counts as empty."""
    return F.coalesce(F.col(quoted(column)).cast("string"), F.lit(""))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, base: str) -> str:
    """A column name that `df` does not have in any spelling."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def known(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, hash, text): each row whole, its id, its text and the text's hash, so that no column's name can clash."""
    text = whole_text(text_col)
    return docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), F.col(quoted(id_col)).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows and about `most_bytes` bytes, so that what Python derives from a slice stays small.

    A row larger than `most_bytes` comes alone."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).get_total_buffer_size() and _sliced_bytes(batch.slice(at, n)) > most_bytes:
                n //= 2
            yield batch.slice(at, n)
            at += n


def _sliced_bytes(batch: pa.RecordBatch) -> int:
    return batch.nbytes


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` for mapInArrow, after which the worker gives its freed memory back to the system: workers serve many operators."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        forget()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return whole


def within_bytes(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, int]]:
    """(text, label) of the rows of a sample that fit into `most` bytes of text, one by one; a row that does not fit is left out."""
    for b in small_batches(batches):
        for text, label in zip(b.column("text"), b.column("label").to_pylist(), strict=True):
            size = len(text.as_buffer())
            if size <= most:
                most -= size
                yield text.as_py(), label


def fold_of(doc_id: str, modulus: int) -> Column:
    """The fold of a row: the CRC-32 of its id, written in decimal, modulo `modulus` (null ids: null)."""
    return F.crc32(F.col(quoted(doc_id)).cast("string").cast("binary")) % F.lit(modulus)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, bound: int) -> DataFrame:
    """At most `bound` labelled training rows as (doc_id, label, text), one for each doc_id, chosen by a hash of the id.

    `train` is a condition on the labels' doc_id. Several labels of an id are averaged (a half counts as 1); of
    several texts of an id the one with the least hash is taken. The bound keeps the broadcast and the trainer's
    memory small at every size of the corpus; the choice does not depend on partitions."""
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train)
        .groupBy("doc_id")
        .agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    texts = docs.select(F.col("doc_id"), whole_text().alias("text")).join(F.broadcast(picked), "doc_id")
    least = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    return texts.withColumn("__n", F.row_number().over(least)).where("__n = 1").drop("__n")
