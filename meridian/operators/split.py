"""Stratified splits whose membership follows from a hash of seed and id: the same for every partitioning and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def stratified(df: DataFrame, strata: list[str], key: str, fraction: float, seed: int = 42, rule: str = "round") -> DataFrame:
    """`df` with a column validation (boolean). Of a cell of n rows max(1, n * fraction) are for validation, rounded half
    to even (rule round) or down (rule floor)."""
    cell = Window.partitionBy(*strata)
    share = F.count(F.lit(1)).over(cell) * F.lit(float(fraction))
    wanted = F.greatest(F.lit(1), (F.rint(share) if rule == "round" else F.floor(share)).cast("int"))
    place = F.row_number().over(cell.orderBy(hash_order(F.col(key), seed), key))
    return df.withColumn("__place", place).withColumn("__wanted", wanted).withColumn("validation", F.col("__place") <= F.col("__wanted")).drop("__place", "__wanted")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(hash_order(F.col(key), seed), key)


def disjoint(a: DataFrame, b: DataFrame, key: str) -> bool:
    return a.join(b.select(key), key, "left_semi").isEmpty()


def balance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): how many rows each value of each column has."""
    sets = df.groupingSets([[F.col(c)] for c in columns], *columns).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    out = None
    for i, c in enumerate(columns):
        own = sets.where(F.col("g") == (1 << len(columns)) - 1 - (1 << (len(columns) - 1 - i))).select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), "n")
        out = own if out is None else out.unionByName(own)
    return out


def manifest(train: DataFrame, validation: DataFrame, strata: list[str], seed: int, fraction: float) -> dict:
    """Counts of both parts by each stratum's values: a few rows for each."""
    part = lambda df: {"rows": df.count(), **{f"by_{c}": {r["value"]: r["n"] for r in sorted(balance(df, strata).where(F.col("column") == c).collect(), key=lambda r: str(r["value"]))} for c in strata}}
    return {"seed": seed, "val_fraction": fraction, "stratified_by": strata, "train": part(train), "validation": part(validation)}


def fingerprint(df: DataFrame, seed: int = 42) -> dict:
    """Rows, columns, a digest that no order of rows changes, and five rows by hash order.

    A row's digest is the MD5 of its values as JSON; those of the rows are summed as numbers, in parts that cannot overflow."""
    digest = F.md5(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    parts = [F.sum(F.conv(F.substring(digest, i, 8), 16, 10).cast("decimal(38,0)")).alias(f"d{i}") for i in (1, 9, 17, 25)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *parts).first()
    sample = df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), digest))).limit(5)
    return {"rows": row["n"], "columns": len(df.columns), "digest": "-".join(str(row[f"d{i}"] or 0) for i in (1, 9, 17, 25)), "sample": [r.asDict() for r in sample.collect()]}
