"""Token sequences for training: cut, masked and padded as array columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORED = -100


def joined(prompt: Column, answer: Column, end: int | None, longest: int) -> Column:
    """Ids of prompt and answer with the end id, cut to the longest length."""
    tail = F.array(F.lit(end)) if end is not None else F.array().cast("array<int>")
    return F.slice(F.concat(prompt, answer, tail), F.lit(1), F.lit(longest))


def labels(ids: Column, prompt_size: Column) -> Column:
    """The ids, with IGNORED in place of the prompt's."""
    return F.transform(ids, lambda x, i: F.when(i < prompt_size, F.lit(IGNORED).cast("int")).otherwise(x))


def padded_size(size: Column, multiple: int = 8) -> Column:
    return (F.ceil(size / F.lit(float(multiple))) * multiple).cast("int")


def padded(ids: Column, size: Column, by: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(by), F.greatest(size - F.size(ids), F.lit(0))))


def mask(ids: Column, size: Column) -> Column:
    return padded(F.transform(ids, lambda _: F.lit(1)), size, 0)


def batched(df: DataFrame, size: int, order: list[str]) -> DataFrame:
    """`df` with the number of each row's batch of `size` rows in an order."""
    from meridian.operators.ordering import numbered_rows

    numbered = numbered_rows(df, [F.col(c) for c in order], "__n")
    return numbered.withColumn("batch", F.floor(F.col("__n") / size)).drop("__n")


def padded_batches(df: DataFrame, ids: str, prompt_size: str, pad: int, multiple: int = 8) -> DataFrame:
    """A batch's rows padded to its longest, rounded up to a multiple: input_ids, attention_mask and labels."""
    size = padded_size(F.max(F.size(ids)).over(Window.partitionBy("batch")), multiple)
    sized = df.withColumn("padded_to", size)
    own, to = F.col(ids), F.col("padded_to")
    return sized.select("*", padded(own, to, pad).alias("input_ids"), mask(own, to).alias("attention_mask"), padded(labels(own, F.col(prompt_size)), to, IGNORED).alias("labels"))


def inferred(df: DataFrame, predict: Callable[[list[str]], list[str]], question: str = "question", output: str = "raw_output", size: int = 4, fallback: str = "") -> DataFrame:
    """`df` with the answers of a function that takes a batch of questions; a batch on which it fails gets `fallback`.

    A hook: the function comes with the model and runs on executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[str] = []
            for at in range(0, len(frame), size):
                part = frame[question].iloc[at : at + size].fillna("").tolist()
                try:
                    out += predict(part)
                except Exception:
                    out += [fallback] * len(part)
            yield frame.assign(**{output: out})

    return df.mapInPandas(run, df.withColumn(output, F.lit("")).schema)


def merged(base: DataFrame, finetuned: DataFrame | None, key: str, column: str) -> DataFrame:
    """Both models' outputs by record; without a second model the base's are copied. Missing ones count as ""."""
    left = base.withColumnRenamed(column, f"{column}_base")
    if finetuned is None:
        return left.withColumn(f"{column}_finetuned", F.col(f"{column}_base"))
    right = finetuned.select(key, F.col(column).alias(f"{column}_finetuned"))
    both = left.join(right, key, "left")
    return both.withColumns({f"{column}_{m}": F.coalesce(F.col(f"{column}_{m}"), F.lit("")) for m in ("base", "finetuned")})
