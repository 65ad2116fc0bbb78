"""Equality of two result sets, in Spark: as sets, multisets, lists, or lists that may differ within ties.

Columns are compared by place, names ignored; other numbers of columns differ. Values of different numeric types are
widened to a common one. Nulls equal nulls. Lists need an index column that gives each row's place (see `indexed`).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridian.plans.sql_compare import order_keys

INDEX = "__place"
_ORDER = re.compile(r"\border\s+by\b", re.I)


def _common(a: T.DataType, b: T.DataType) -> str:
    """The type in which both are compared: as they are if equal; doubles or long decimals for numbers; else JSON text."""
    if a == b and not isinstance(a, (T.ArrayType, T.MapType, T.StructType)):
        return a.simpleString()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return "double" if isinstance(a, T.FractionalType) and not isinstance(a, T.DecimalType) or isinstance(b, T.FractionalType) and not isinstance(b, T.DecimalType) else "decimal(38,10)"
    return "json" if isinstance(a, (T.ArrayType, T.MapType, T.StructType)) or isinstance(b, (T.ArrayType, T.MapType, T.StructType)) else "string"


def _aligned(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, list[str]] | None:
    left, right = ([f for f in df.schema.fields if f.name != INDEX] for df in (a, b))
    if len(left) != len(right):
        return None
    names = [f"_c{i}" for i in range(len(left))]

    def cast(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
        flat = df.toDF(*[f"__{i}" for i in range(len(df.columns))])
        places = [i for i, c in enumerate(df.columns) if c != INDEX]
        out = []
        for i, name, x, y in zip(places, names, left, right, strict=True):
            kind = _common(x.dataType, y.dataType)
            c = F.col(f"__{i}")
            out.append((F.to_json(F.struct(c)) if kind == "json" else c.cast(kind)).alias(name))
        if INDEX in df.columns:
            out.append(F.col(f"__{df.columns.index(INDEX)}").alias(INDEX))
        return flat.select(*out)

    return cast(a, left), cast(b, right), names


def indexed(df: DataFrame, *order: Column | str) -> DataFrame:
    """Numbers rows in an order, without moving them all to one task: partitions are sorted ranges, and each partition's
    first number is the sum of the counts before it (as many numbers as there are partitions).

    The columns `order` must decide the order of any two rows that differ."""
    from meridian.operators.ordering import numbered_rows

    return numbered_rows(df, [F.col(o) if isinstance(o, str) else o for o in order], INDEX)


def same_set(a: DataFrame, b: DataFrame) -> bool:
    if (both := _aligned(a, b)) is None:
        return False
    x, y, names = both
    x, y = x.select(*names).distinct(), y.select(*names).distinct()
    return x.subtract(y).isEmpty() and y.subtract(x).isEmpty()


def same_multiset(a: DataFrame, b: DataFrame) -> bool:
    """By counts of each row, one shuffle for both sides."""
    if (both := _aligned(a, b)) is None:
        return False
    x, y, names = both
    sides = x.select(*names, F.lit(1).alias("__n")).unionByName(y.select(*names, F.lit(-1).alias("__n")))
    return sides.groupBy(*names).agg(F.sum("__n").alias("__n")).where("__n <> 0").isEmpty()


def _same_places(x: DataFrame, y: DataFrame, names: list[str]) -> bool:
    left, right = x.select(INDEX, F.struct(*names).alias("a")), y.select(INDEX, F.struct(*names).alias("b"))
    return left.join(right, INDEX, "full").where(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()


def same_list(a: DataFrame, b: DataFrame) -> bool:
    if (both := _aligned(a, b)) is None:
        return False
    return _same_places(*both)


def same_but_for_ties(a: DataFrame, b: DataFrame, keys: list[int]) -> bool:
    """The same multiset, and the same sequence of the key columns."""
    if (both := _aligned(a, b)) is None:
        return False
    x, y, names = both
    if not same_multiset(a.drop(INDEX), b.drop(INDEX)):
        return False
    return not keys or _same_places(x, y, [names[k] for k in keys if k < len(names)] or names)


def mode_by_text(gold: str | None, mode: str) -> str:
    """auto_text: list if the gold text has ORDER BY anywhere, else multiset."""
    return mode if mode != "auto_text" else "list" if _ORDER.search(gold or "") else "multiset"


def mode_by_keys(gold: str | None, mode: str) -> tuple[str, list[int] | None]:
    """auto_robust: ordered_robust if the gold query's sort keys are output columns, else multiset."""
    keys = order_keys(gold or "") if mode in ("auto_robust", "ordered_robust") else None
    return ("ordered_robust" if keys else "multiset") if mode == "auto_robust" else mode, keys


def same(a: DataFrame, b: DataFrame, mode: str, keys: list[int] | None = None) -> bool:
    if mode == "set":
        return same_set(a.drop(INDEX), b.drop(INDEX))
    if mode == "list":
        return same_list(a, b)
    if mode == "ordered_robust" and keys:
        return same_but_for_ties(a, b, keys)
    if mode in ("multiset", "ordered_robust"):
        return same_multiset(a.drop(INDEX), b.drop(INDEX))
    raise ValueError(f"unknown mode {mode!r}")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with how many more the left side has of them (fewer: negative)."""
    both = _aligned(a, b)
    if both is None:
        raise ValueError("the sides have other numbers of columns")
    x, y, names = both
    sides = x.select(*names, F.lit(1).alias("surplus")).unionByName(y.select(*names, F.lit(-1).alias("surplus")))
    return sides.groupBy(*names).agg(F.sum("surplus").alias("surplus")).where("surplus <> 0")


def deduplicated(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the order given."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
