"""Operator 8: SimHash near-duplicates linked by the generalised pigeonhole principle.

A document's fingerprint has a bit set where over half of its word shingles' hashes have it. Two fingerprints within
`most` bits are linked, and a component is what links reach.

Links are sought between distinct fingerprints only, so copies cost nothing. The 64 bits are dealt to m partitions,
correlated bits together, and each partition i gets a threshold T_i >= -1 with sum(T) = most - m + 1: a pair within
`most` bits then agrees to T_i bits in some partition i (-1: that partition is not probed). Dynamic programming picks
the thresholds, and m, of least estimated cost: candidate pairs, counted on a sample of at most SAMPLE fingerprints
and scaled, plus rows to be shuffled. Index and probe rows meet in an equi-join whose condition verifies the pair.

A bucket of over BUCKET fingerprints is not paired off. Whoever would probe it takes the exact way instead: two
fingerprints are within two bits if and only if some code is within one bit of both, so each is linked to the least
fingerprint around each of its 65 nearest codes, of which at most 65 fingerprints share one. That is linear in the
fingerprints and links the same components; nothing is capped.

Null and empty texts have no words and the fingerprint zero; they link like any other. Rows are kept one for one. A
null id does not count for a component's least id; a component of null ids only has a null one. Texts are taken
whole, in blocks of shingles. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import checkpointed, discarded, known, quoted, small_batches, tidy, whole_text

SAMPLE, BUCKET, BLOCK = 20_000, 64, 16_384
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str, shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit number. A-Z are lower-cased; words part at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0

    def block(at: int) -> np.ndarray:
        part = words[at : at + BLOCK + shingle - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        return np.fromiter(map(_hash, joined), "<u8")

    return majority(map(block, range(0, max(1, len(words) - shingle + 1), BLOCK)))


def majority(blocks: Iterable[np.ndarray]) -> int:
    """The fingerprint of shingles with these hashes (64 bits each, in blocks): the bits set in over half of them."""
    n, ones = 0, np.zeros(64, np.int64)
    for hashes in blocks:
        n += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keys: list[str], text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The columns `keys` and `fp` of every row; `keys` must not hold a column named fp or text_."""
    rows = docs.select(*map(quoted, keys), whole_text(text_col).alias("text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            found = pa.array([fingerprint(t, shingle) for t in b.column("text_").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], found], [*keys, "fp"])

    return rows.mapInArrow(tidy(run), rows.drop("text_").withColumn("fp", F.lit(0).cast("long")).schema)


def partitions(bits: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits, each filled up with the bits that correlate most with it."""
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.abs(np.nan_to_num(np.corrcoef(bits.T))) if len(bits) > 1 else np.zeros((64, 64))
    left, groups = set(range(64)), []
    for g in range(m):
        size = 64 // m + (g < 64 % m)
        group = [max(sorted(left), key=lambda b: c[b, sorted(left)].sum())]
        left.remove(group[0])
        while len(group) < size:
            nearest = max(sorted(left), key=lambda b: c[b, group].sum())
            group.append(nearest)
            left.remove(nearest)
        groups.append(sorted(group))
    return groups


def mask_of(group: list[int]) -> int:
    return int(np.array([sum(1 << b for b in group)], np.uint64).view(np.int64)[0])


def plan(sample: np.ndarray, total: int, most: int = 2) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition, by dynamic programming on the estimated cost."""
    codes = sample.view(np.uint64)
    bits = ((codes[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(float)
    best: tuple[float, list] = (float("inf"), [])
    scale = (total / max(1, len(codes))) ** 2
    for m in range(1, most + 4):
        groups = partitions(bits, m)
        costs = []
        for group in groups:
            keys, counts = np.unique(codes & np.uint64(sum(1 << b for b in group)), return_counts=True)
            same = (counts * (counts - 1.0) / 2).sum() * scale + total**2 / 2.0 ** (len(group) + 1)
            near = 0.0
            for b in group:
                at = np.searchsorted(keys, keys ^ np.uint64(1 << b))
                hit = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == keys ^ np.uint64(1 << b))
                near += (counts[hit] * counts[at[hit]]).sum() / 2.0
            costs.append({-1: 0.0, 0: same + total, 1: same + near * scale + total * (len(group) + 2.0)})
        table = {0: (0.0, [])}  # by the sum of thresholds so far
        for cost in costs:
            step: dict[int, tuple[float, list]] = {}
            for s, (c, chosen) in table.items():
                for t, x in cost.items():
                    if s + t not in step or c + x < step[s + t][0]:
                        step[s + t] = (c + x, [*chosen, t])
            table = step
        if (found := table.get(most - m + 1)) and found[0] < best[0]:
            best = (found[0], list(zip(groups, found[1], strict=True)))
    return best[1]


def _within(a: Column, b: Column, most: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= most


def links(nodes: DataFrame, most: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) of distinct fingerprints, u > v, whose components are those of all pairs within `most` bits.

    `nodes` has one column fp of distinct values and is read more than once: give a checkpoint. Other thresholds than
    two bits are refused, as crowded buckets have no exact way for them."""
    if most != 2:
        raise ValueError("fingerprints are linked within two bits")
    total = nodes.count()
    sample = np.array([r[0] for r in nodes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64)
    chosen = [(i, group, t) for i, (group, t) in enumerate(plan(sample, total, most)) if t >= 0]

    def key(group: list[int], flip: int | None = None) -> Column:
        k = F.col("fp").bitwiseAND(F.lit(mask_of(group)))
        return k if flip is None else k.bitwiseXOR(F.lit(mask_of([flip])))

    def rows(keys: list[Column]) -> DataFrame:
        return nodes.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.*")

    index = rows([F.struct(F.lit(i).alias("part"), key(g).alias("key")) for i, g, _ in chosen])
    flips = [F.struct(F.lit(i).alias("part"), key(g, b).alias("key")) for i, g, t in chosen if t == 1 for b in g]
    sizes = index.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"))
    lone = F.col("part").isin([i for i, _, t in chosen if t == 0]) & (F.col("n") < 2)
    sizes = checkpointed(sizes.where(~lone))
    probes = index.unionByName(rows(flips)) if flips else index
    paired = index.join(sizes.where(F.col("n") <= bucket), ["part", "key"]).select("part", "key", F.col("fp").alias("v"))
    found = probes.join(paired, ["part", "key"]).where((F.col("v") < F.col("fp")) & _within(F.col("fp"), F.col("v"), most)).select(F.col("fp").alias("u"), "v")
    large = sizes.where(F.col("n") > bucket).select("part", "key")
    if not large.isEmpty():
        crowded = probes.join(large, ["part", "key"], "left_semi").select("fp").distinct()
        around = [F.lit(0).cast("long"), *(F.lit(mask_of([b])) for b in range(64))]
        codes = crowded.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(x) for x in around))).alias("code"))
        shared = codes.groupBy("code").agg(F.collect_list("fp").alias("near")).where(F.size("near") > 1)  # 65 at most
        stars = shared.select(F.explode("near").alias("u"), F.array_min("near").alias("v")).where("u > v")
        found = found.unionByName(stars)
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node that has a lesser one in its component, and the least of it. By large and small stars."""
    e, before = checkpointed(edges.select("u", "v")), None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if state == before or not state[0]:
            return e
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        last, e = e, checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discarded(last)


def near_duplicates(prints: DataFrame, most: int = 2) -> DataFrame:
    """(fp, root, component_id, copies): each distinct fingerprint's class, named by its least fingerprint and by its least id.

    `prints` has columns id and fp, a row for each document, and is read more than once: give a checkpoint."""
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")))
    stars = components(links(nodes.select("fp"), most))
    rooted = nodes.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id", "copies")


def one_of_each(rows: DataFrame, prints: DataFrame, roots: DataFrame) -> DataFrame:
    """The documents of which one stays for each root: that of the least id (null ids last), then of the least hash of its
    text; of rows equal in both, the one that comes first as JSON.

    `rows` are common.known(); `prints` (id, hash, fp) and `roots` (fp, root) hold the decisions, so texts are shuffled once."""
    order = F.struct(F.col("id").isNull(), "id", "hash")
    keep = prints.groupBy("id", "hash", "fp").agg(F.count(F.lit(1)).alias("copies")).join(roots, "fp")
    keep = checkpointed(keep.groupBy("root").agg(F.min_by(F.struct("id", "hash", "copies"), order).alias("kept")).select("kept.*"))
    mine = keep.select(F.col("id").alias("its_id"), F.col("hash").alias("its_hash"), "copies")
    kept = rows.drop("text").join(mine, F.col("id").eqNullSafe(F.col("its_id")) & (F.col("hash") == F.col("its_hash")))
    if not keep.where("copies > 1").isEmpty():
        first = kept.where("copies > 1").groupBy("id", "hash").agg(F.min_by("row", F.to_json("row")).alias("row"))
        return kept.where("copies = 1").select("row").unionByName(first.select("row")).select("row.*")
    return kept.select("row.*")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2) -> DataFrame:
    """The rows of `docs` of which one stays for each component, chosen as in one_of_each. All columns are kept.

    A row is known by its id and its text's hash; the decisions are made on those and the fingerprints alone."""
    rows = known(docs, id_col, text_col)
    prints = checkpointed(fingerprints(rows, ["id", "hash"]))
    return one_of_each(rows, prints, near_duplicates(prints, most).select("fp", "root"))
