"""Operator 4: exact top-k search of binary codes by incremental multi-index hashing.

Codes of 64 bits are cut into m segments, m near 64 / log2(rows), and a table for each segment lists the rows by the
segment's value. A query looks up its segments' values, then all values one bit away, two bits away and so on, and
verifies the rows that it meets by their whole Hamming distance. After radius r every code within m * (r + 1) - 1
bits has been met, as one of its segments is within r; so once the k-th verified distance is no more than that, the
result is proved, ties included, and the query stops.

Queries search all rows in blocks: a task indexes one block of rows (at most ROWS) and answers one block of queries
(at most QUERIES) on it, and each query's best of all blocks are merged. A block is dealt out by a hash of the id, so a
frequent code does not crowd one. A bucket of any size is verified, vectorised, within the block's memory.

Null ids and null codes take no part. Equal rows (id and code) count once. A query's own row (by id) is no candidate; with
fewer than k candidates all are returned. Ties go to the smaller id. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import checkpointed

ROWS, QUERIES, LEAST_QUERIES = 1 << 18, 1 << 16, 256


def sign_code(vector: Column) -> Column:
    """64 bits of a vector of up to 64 components: bit i is set if component i is over 0. Null for null or longer vectors."""
    bits = F.transform(vector, lambda x, i: F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(F.arrays_zip(bits.alias("b"), F.sequence(F.lit(0), F.size(bits) - 1).alias("i")), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", x["b"], x["i"])))
    return F.when((F.size(vector) > 0) & (F.size(vector) <= 64), code)


@cache
def masks(width: int, radius: int) -> np.ndarray:
    """All values of `width` bits with `radius` of them set."""
    return np.array([sum(1 << b for b in chosen) for chosen in combinations(range(width), radius)], np.int64)


class Index:
    """Tables of the segments' values, by sorting."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        m = max(1, min(32, round(64 / max(1.0, math.log2(max(2, len(codes)))))))
        edges = [64 * i // m for i in range(m + 1)]
        self.segments = [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]
        self.orders, self.values, self.starts = [], [], []
        for lo, width in self.segments:
            own = self.part(codes, lo, width)
            order = np.argsort(own, kind="stable")
            value, start = np.unique(own[order], return_index=True)
            self.orders.append(order)
            self.values.append(value)
            self.starts.append(np.append(start, len(codes)))

    @staticmethod
    def part(codes, lo: int, width: int):
        return (codes >> np.uint64(lo)).astype(np.int64) & ((1 << width) - 1) if width < 64 else codes.astype(np.int64)

    def met(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows that have a segment at exactly that distance."""
        out = []
        for (lo, width), order, value, start in zip(self.segments, self.orders, self.values, self.starts, strict=True):
            if radius > width:
                continue
            own = self.part(code, lo, width)
            if math.comb(width, radius) < len(value):
                wanted = own ^ masks(width, radius)
                at = np.searchsorted(value, wanted)
                at = at[(at < len(value)) & (value[np.minimum(at, len(value) - 1)] == wanted)]
            else:  # fewer values than flips: look at the values
                at = np.flatnonzero(np.bitwise_count(value ^ own) == radius)
            out += [order[start[i] : start[i + 1]] for i in at]
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def nearest(self, code: np.uint64, k: int, ids: np.ndarray, own_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of the k nearest but the query's own, by distance, then id."""
        seen = np.empty(0, np.int64)
        for radius in range(max(w for _, w in self.segments) + 1):
            found = self.met(code, radius)
            seen = np.union1d(seen, found[ids[found] != own_id])
            distance = np.bitwise_count(self.codes[seen] ^ code)
            if len(seen) >= k and np.partition(distance, k - 1)[k - 1] <= len(self.segments) * (radius + 1) - 1:
                break
        best = np.lexsort((ids[seen], distance))[:k]
        return seen[best], distance[best]


def search(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, id, distance) of the k nearest rows of each query; both have columns id long and code long."""
    rows = checkpointed(rows.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code").distinct())
    queries = checkpointed(queries.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code").distinct())
    n, asked = rows.count(), queries.count()
    row_blocks = max(1, -(-n // ROWS))
    width = min(QUERIES, max(LEAST_QUERIES, -(-asked // rows.sparkSession.sparkContext.defaultParallelism)))
    query_blocks = max(1, -(-asked // width))
    number = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    left = rows.select("id", "code", F.lit(False).alias("asks"), number(row_blocks).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    right = queries.select("id", "code", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"), number(query_blocks).alias("qb"))

    def answered(t: pa.Table) -> pa.Table:
        asks = np.array(t.column("asks"))
        ids, codes = np.array(t.column("id")), np.array(t.column("code")).view(np.uint64)
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]]
        if asks.any() and not asks.all():
            own, index = ids[~asks], Index(codes[~asks])
            for q, code in zip(ids[asks], codes[asks], strict=True):
                at, distance = index.nearest(code, k, own, q)
                out[0].append(np.full(len(at), q)), out[1].append(own[at]), out[2].append(distance.astype(np.int32))
        return pa.table(dict(zip(["query_id", "id", "distance"], map(np.concatenate, out), strict=True)))

    dealt = left.unionByName(right).repartition(min(20_000, row_blocks * query_blocks), "rb", "qb")  # by groups, which are few bytes but much work
    found = dealt.groupBy("rb", "qb").applyInArrow(answered, "query_id long, id long, distance int")
    best = found.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
