"""Operator 1: approximate nearest neighbours by shifted Hilbert curves.

Each ordering projects the vectors at random to a few dimensions, shifts them, and numbers the cells of a grid along a
Hilbert curve; a hash of the id breaks ties, so that equal keys still part into blocks. Quantiles of the keys cut an
ordering into blocks of about BLOCK rows. A query looks into the block of its own key and the neighbouring ones, where
it is compared with all rows in double precision; the candidates of all orderings merge, and the best stay.

How many neighbouring blocks are needed is measured, not guessed: at most PILOTS queries (those of least hash) are
compared with all rows, and the reach is the least at which the orderings bring them at least RECALL of their true
neighbours. Clustered vectors need a reach of 0 or 1. Where all directions are alike, near and far hardly differ in any
projection, and the reach grows until most blocks are read; the README has figures.

Vectors that are null, zero, or hold null or non-finite components take no part, as queries or as candidates. Vectors
are compared with those of their own dimension. Rows whose vector and id repeat count once; of equal vectors under
different ids each is a candidate. Ties go to the smaller id. Null ids take no part. Blocks are range-partitioned by
(ordering, block). Where more than about ASKED queries look into a block, they are dealt to several copies of it by
a hash of their ids, so a group holds a block of rows and about ASKED queries at every size of the table. There are
MOST_BLOCKS blocks at most, which bounds the quantiles; tables of over BLOCK * MOST_BLOCKS rows have larger ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import checkpointed, quoted, small_batches

ORDERINGS, DIMENSIONS, BITS = 4, 4, 6
BLOCK, MOST_BLOCKS, ASKED, PILOTS, RECALL = 4096, 100_000, 8192, 128, 0.97
_TIE = 1 << 16


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of grid cells, one row each: Skilling's transform, for all rows at once."""
    x = cells.T.astype(np.int64).copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> bit) & 1
    return key


def usable(vectors: list) -> list[np.ndarray | None]:
    """The vectors in double precision; None for those that take no part."""
    out = []
    for v in vectors:
        if v is None or not len(v) or any(c is None for c in v):
            out.append(None)
            continue
        a = np.asarray(v, np.float64)
        out.append(a if np.isfinite(a).all() and a.any() else None)
    return out


def keys(unit: np.ndarray, ids: np.ndarray, ordering: int, dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Keys of unit vectors in an ordering. The projection's spread is known: components of unit vectors vary as 1/dimension."""
    size = unit.shape[1]
    rng = np.random.default_rng([ordering, size])
    flat = unit @ rng.standard_normal((size, dimensions)) + rng.uniform(-0.5, 0.5, dimensions)
    cells = np.clip(((flat + 3.0) / 6.0 * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)
    tie = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)
    return hilbert(cells, bits) * _TIE + tie


def _rows(vectors: DataFrame, orderings: int) -> DataFrame:
    """(id, dim, vector binary of doubles, keys array<long>) of each vector that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 2048):
            found = [(i, v) for i, v in zip(b.column("id").to_pylist(), usable(b.column("v").to_pylist()), strict=True) if v is not None]
            for size in sorted({len(v) for _, v in found}):
                ids = np.array([i for i, v in found if len(v) == size], np.int64)
                x = np.stack([v for _, v in found if len(v) == size])
                scaled = x / np.abs(x).max(axis=1, keepdims=True)
                unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
                k = np.stack([keys(unit, ids, r) for r in range(orderings)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), size), pa.int32()), pa.array([u.tobytes() for u in unit], pa.binary()), pa.array(k.tolist(), pa.list_(pa.int64()))], ["id", "dim", "vector", "keys"])

    return vectors.mapInArrow(run, "id long, dim int, vector binary, keys array<long>")


def best_of(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, step: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries', rows' indices, cosines) of each query's k nearest rows but itself, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    for at in range(0, len(queries), step):
        q = query_ids[at : at + step]
        cosine = np.round(queries[at : at + step] @ rows.T, 14)  # so that equal vectors tie
        cosine[q[:, None] == ids[None, :]] = -np.inf
        if len(ids) > k:
            least = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
            qi, ri = np.nonzero(cosine >= least)
        else:
            qi, ri = np.nonzero(cosine > -np.inf)
        c = cosine[qi, ri]
        sorted_ = np.lexsort((ri, -c, qi))
        qi, ri, c = qi[sorted_], ri[sorted_], c[sorted_]
        first = np.searchsorted(qi, qi)
        keep = (np.arange(len(qi)) - first < k) & (c > -np.inf)
        qi, ri = qi[keep], ri[keep]
        yield q[qi], order[ri], np.einsum("ij,ij->i", queries[at : at + step][qi], rows[ri])


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _reach(rows: DataFrame, queries: DataFrame, cuts: dict, k: int, pilots: int, recall: float) -> int:
    """The blocks on each side that bring the pilots enough of their true neighbours."""
    some = queries.orderBy(F.xxhash64("id"), "id").limit(pilots).collect()
    by_dim = {d: [r for r in some if r["dim"] == d] for d in {r["dim"] for r in some}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.array(b.column("dim"))
            for d, own in by_dim.items():
                at = np.flatnonzero(dims == d)
                if not len(at):
                    continue
                part = b.take(pa.array(at))
                ids, x = np.array(part.column("id")), _matrix(part.column("vector").to_pylist())
                here = part.column("keys").to_pylist()
                mine = {r["id"]: r["keys"] for r in own}
                for q, ri, c in best_of(np.array([r["id"] for r in own]), _matrix([bytes(r["vector"]) for r in own]), ids, x, k):
                    apart = [min(abs(int(np.searchsorted(cuts[d, o], a, "right")) - int(np.searchsorted(cuts[d, o], z, "right"))) for o, (a, z) in enumerate(zip(mine[i], here[j], strict=True))) for i, j in zip(q, ri, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids[ri]), pa.array(c), pa.array(apart, pa.int32())], ["query", "id", "cosine", "apart"])

    near = rows.mapInArrow(run, "query long, id long, cosine double, apart int").dropDuplicates(["query", "id"])
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "id"))
    counts = near.withColumn("n", rank).where(F.col("n") <= k).groupBy("apart").count().collect()
    total, reach, got = sum(r["count"] for r in counts), 0, 0
    for r in sorted(counts, key=lambda r: r["apart"]):
        if got >= recall * total:
            break
        got, reach = got + r["count"], r["apart"]
    return reach


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", orderings: int = ORDERINGS, block: int = BLOCK, pilots: int = PILOTS, recall: float = RECALL, most_asked: int = ASKED) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of each query among `vectors`."""
    pick = lambda df: df.where(F.col(quoted(id_col)).isNotNull()).select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(vector_col)).alias("v"))
    once = lambda df: checkpointed(_rows(pick(df), orderings).dropDuplicates(["id", "vector"]))
    rows, asked = once(vectors), once(queries)
    sizes = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}
    block = max(block, -(-sum(sizes.values()) // MOST_BLOCKS))
    cuts: dict[tuple[int, int], np.ndarray] = {}
    for dim, n in sizes.items():
        parts = -(-n // block)
        shares = [i / parts for i in range(1, parts)] or [0.5]
        found = rows.where(F.col("dim") == dim).agg(*(F.percentile_approx(F.col("keys")[o], shares, max(10_000, 20 * parts)).alias(f"o{o}") for o in range(orderings))).first()
        for o in range(orderings):
            cuts[dim, o] = np.array(found[o] if parts > 1 else [], np.int64)
    reach = _reach(rows, asked, cuts, k, pilots, recall)
    asking = {r["dim"]: r["count"] for r in asked.groupBy("dim").count().collect()}
    copies = {d: max(1, -(-asking.get(d, 0) * min(2 * reach + 1, len(cuts[d, 0]) + 1) // (most_asked * (len(cuts[d, 0]) + 1)))) for d in sizes}
    shared = vectors.sparkSession.sparkContext.broadcast(cuts)  # 8 bytes for each block and ordering

    def dealt(is_query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in small_batches(batches, 2048):
                for (dim, o), own in shared.value.items():
                    at = np.flatnonzero(np.array(b.column("dim")) == dim)
                    part = b.take(pa.array(at))
                    key = np.array([k[o] for k in part.column("keys").to_pylist()], np.int64)
                    block_of = np.searchsorted(own, key, "right")
                    last, width = len(own), min(2 * reach, len(own))
                    first = np.clip(block_of - reach, 0, last - width)  # at an end the window is moved in
                    ids = np.array(part.column("id"), np.int64)
                    whole = lambda v, kind: pa.array(np.broadcast_to(v, len(ids)), kind)  # noqa: B023, E731
                    for step in range(width + 1) if is_query else range(copies[dim]):
                        to, copy = (first + step, ids % copies[dim]) if is_query else (block_of, step)
                        yield pa.RecordBatch.from_arrays([whole(dim * 1000 + o, pa.int32()), whole(to, pa.int32()), whole(copy, pa.int32()), whole(is_query, pa.bool_()), part.column("id"), part.column("vector")], ["curve", "block", "copy", "asks", "id", "vector"])

        return run

    kind = "curve int, block int, copy int, asks boolean, id long, vector binary"
    both = rows.mapInArrow(dealt(False), kind).unionByName(asked.mapInArrow(dealt(True), kind))

    def compared(t: pa.Table) -> pa.Table:
        asks = np.array(t.column("asks"))
        ids, x = np.array(t.column("id")), _matrix(t.column("vector").to_pylist())
        q, i, c = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if asks.any() and not asks.all():
            for qs, ri, cs in best_of(ids[asks], x[asks], ids[~asks], x[~asks], k):
                q.append(qs), i.append(ids[~asks][ri]), c.append(cs)
        return pa.table({"query_id": np.concatenate(q), "id": np.concatenate(i), "score": np.concatenate(c)})

    parts = max(1, orderings * sum(-(-n // block) * copies[d] for d, n in sizes.items()))
    found = both.repartitionByRange(min(parts, 20_000), "curve", "block", "copy").groupBy("curve", "block", "copy").applyInArrow(compared, "query_id long, id long, score double")
    merged = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
