"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, found exactly.

Documents with equal sets are one node. Two sets of similarity 4/5 share a shingle among the first n - ceil(4n/5) + 1 of
each, in any order that all sets follow (prefix filtering), and the smaller set has it among its first n / 9. Shingles go
from rare to common: a sample of about SAMPLE documents gives a first order; then the shingles of all prefixes are
counted, those that FREQUENT or more prefixes have count as common, and so do their neighbours in the text (within
NEAR places) that as many of those texts have; the prefixes that hold one are made anew, up to ROUNDS times. The order decides the cost alone. Nodes that share such a shingle are candidates where their sizes,
the places of the shingle and the sets' counts by hash bucket (which bound what they share from above) leave room for the
similarity, and each candidate is verified on the whole sets. Sets are made anew for candidates only.

The fingerprints come first, as operator 8 has them but for five-word shingles: simhash.links finds those within two bits
by the generalised pigeonhole principle, and what it links is verified on the whole sets. Two sets of similarity 4/5 may
be ten bits apart, too far for any pigeonhole; the prefixes find what the fingerprints do not reach.

Crowded shingles are not paired off at once: with the fingerprints' links, every node is compared with one node for each
shingle, and what links is contracted. That node is the one with the least share of rarer shingles before it: of copies
changed here and there the one changed least, which most others are similar to. Where that leaves many more pairs than
places, it is done once more, with other nodes. Then only pairs of different components are left, of which one at least is
outside the shingle's largest component. Components are those of all similar pairs; nothing is capped.

Words are those of the fingerprints (A-Z lower-cased, parted at ASCII white space). A text of one to four words is one
shingle; texts without words are copies of each other. Shingles and sets are known by 64-bit hashes.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from meridian.llm import simhash
from meridian.llm.common import checkpointed, discarded, known, small_batches, tidy
from meridian.llm.simhash import components, one_of_each

WIDTH, SAMPLE, OFTEN, STARS, MANY, BUCKETS, BITS, MOST_BITS = 5, 10_000, 3, 2, 4, 128, 1 << 24, 1 << 27
FREQUENT, NEAR, ROUNDS, MOST_COMMON = 10, 64, 3, 1 << 20
MOST = 65_535  # sets with more shingles are not judged by their counts
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def sequence(text: str, width: int = WIDTH) -> np.ndarray:
    """The hashes of a text's shingles, in its order."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.fromiter(map(_hash, joined), "<u8").view("<i8")


def shingles(text: str) -> np.ndarray:
    """The distinct hashes of a text's shingles, in ascending order."""
    return np.unique(sequence(text))


def among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Which values occur in `ascending`, by binary search: few values against many cost no sort of the many."""
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def key_of(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), seed=7)).view(np.int64))


def prefix(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles that a similar set must share one of, rare ones first. `common` is sorted; what it lacks counts as rare."""
    if not len(found):
        return found
    at = np.minimum(np.searchsorted(common, found), max(0, len(common) - 1))
    seen = np.where(common[at] == found, counts[at], 0) if len(common) else np.zeros(len(found), np.int64)
    return found[np.lexsort((found, seen))[: len(found) - -(-4 * len(found) // 5) + 1]]


def _mapped(rows: DataFrame, schema: str, derive: Callable[[pa.RecordBatch, list[np.ndarray]], list[pa.Array]], names: list[str]) -> DataFrame:
    """`rows` has the column text_ last; `derive` gives columns from a batch and its texts' shingles in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            yield pa.RecordBatch.from_arrays(derive(b, [sequence(t) for t in b.column("text_").to_pylist()]), names)

    return rows.mapInArrow(tidy(run), schema)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays]), pa.int64()))


def common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that OFTEN or more of the sampled texts have, ascending, and in how many rows they should be. The sample bounds the size."""
    share = min(1.0, SAMPLE / max(1, rows.count()))
    texts = rows.where(F.pmod("hash", F.lit(1_000_003)) < int(1_000_003 * share)).dropDuplicates(["hash"]).select(F.col("text").alias("text_"))
    found = _mapped(texts, "s array<bigint>", lambda b, texts: [_lists([np.unique(h) for h in texts])], ["s"]).select(F.explode("s").alias("s"))
    got = found.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN).toArrow()
    s, n = (np.asarray(got.column(c).to_numpy(), np.int64) for c in ("s", "n"))
    order = np.argsort(s)
    return s[order], (n[order] / share).astype(np.int64)


def prints(rows: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, hash, fp, n, prefix, counts, sim) of every row: the set's key and size, its prefix in order, its counts by bucket, the text's fingerprint."""
    common = rows.sparkSession.sparkContext.broadcast(common)
    names = ["id", "hash", "fp", "n", "prefix", "counts", "sim"]
    counted = lambda s: np.minimum(np.bincount(s & (BUCKETS - 1), minlength=BUCKETS), MOST).astype("<u2").tobytes()

    def derive(b: pa.RecordBatch, texts: list[np.ndarray]) -> list[pa.Array]:
        sets = list(map(np.unique, texts))
        sims = (simhash.majority(h[at : at + simhash.BLOCK] for at in range(0, len(h), simhash.BLOCK)) for h in texts)
        return [*b.columns[:2], pa.array(map(key_of, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), _lists([prefix(s, *common.value) for s in sets]), pa.array(map(counted, sets), pa.binary()), pa.array(sims, pa.int64())]

    kind = rows.schema["id"].dataType.simpleString()
    return _mapped(rows.select("id", "hash", F.col("text").alias("text_")), f"id {kind}, hash bigint, fp bigint, n int, prefix array<bigint>, counts binary, sim bigint", derive, names)


@F.arrow_udf(LongType())
def _most_shared(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """What two sets share at most, by their counts."""
    for pair in batches:
        a, b = (np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(-1, BUCKETS) for c in pair)
        yield pa.array(np.minimum(a, b).sum(axis=1, dtype=np.int64), pa.int64())


def bitmap(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """One bit for each remainder of the column k (long) by `bits`: it tells most other keys apart from these. Its size is `bits`."""
    at, block = F.pmod("k", F.lit(bits)), 32_768
    parts = keys.groupBy(F.floor(at / block).alias("b")).agg(F.bitmap_construct_agg(at % block).alias("bits")).collect()  # bits / block at most
    out = np.zeros((bits // block, block // 8), np.uint8)
    for r in parts:
        out[r["b"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.reshape(-1)


def held(k: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = k % (len(bits) * 8)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def sets_among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k, s): keys and sets of the texts whose hash may be in `wanted` (k): all that are, and few others."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            sets = [shingles(t) for t in b.column("text").filter(pa.array(held(b.column("hash").to_numpy(), shared.value))).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(key_of, sets), pa.int64()), _lists(sets)], ["k", "s"])

    return rows.select("hash", "text").mapInArrow(tidy(run), "k bigint, s array<bigint>")


def verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Of the pairs (u, v) of keys those whose sets are similar, as a checkpoint."""
    side = lambda c: nodes.select(F.col("fp").alias(c), F.col("n").alias(f"n{c}"), F.col("counts").alias(f"c{c}"), F.col("hash").alias(f"h{c}"))
    bound = F.when(F.greatest("nu", "nv") > MOST, F.least("nu", "nv").cast("long")).otherwise(_most_shared("cu", "cv"))
    pairs = checkpointed(pairs.join(side("u"), "u").join(side("v"), "v").where(bound * 9 >= (F.col("nu") + F.col("nv")) * 4).select("u", "v", "hu", "hv"))
    sets = sets_among(rows, pairs.select(F.explode(F.array("hu", "hv")).alias("k")))
    sets = checkpointed(sets.groupBy("k").agg(F.first("s").alias("s")))
    both = pairs.join(sets.select(F.col("k").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("k").alias("v"), F.col("s").alias("b")), "v")
    found = checkpointed(both.where(F.size(F.array_intersect("a", "b")) * 9 >= (F.size("a") + F.size("b")) * 4).select("u", "v"))
    discarded(pairs, sets)
    return found


def settled(nodes: DataFrame, rows: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """`nodes` with prefixes that avoid what is frequent, and (s, rows) of the shingles that two prefixes or more have; both checkpoints.

    A shingle that becomes common moves back in the order, so only prefixes that hold it change."""
    for turn in range(ROUNDS + 1):
        twice = checkpointed(_counted(nodes.select(F.explode("prefix").alias("s"))))
        if turn == ROUNDS or not len((new := _frequent(twice, common))[0]):
            return nodes, twice
        touched = _texts_with(nodes, rows, new[0])
        near = checkpointed(_counted(_around(touched, new[0])))
        common = _merged(_merged(common, new), _frequent(near, common))
        last, nodes = nodes, checkpointed(_again(nodes, touched, common))
        discarded(last, twice, near)
        _freed(nodes)


def _counted(spread: DataFrame) -> DataFrame:
    return spread.groupBy("s").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def _merged(common: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by shingle, the greater where both have one."""
    s, at = np.unique(np.concatenate([common[0], new[0]]), return_inverse=True)
    n = np.zeros(len(s), np.int64)
    np.maximum.at(n, at, np.concatenate([common[1], new[1]]))
    return s, n


def _frequent(counts: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of the shingles counted those that are more than twice as frequent as known, ascending, and their counts; MOST_COMMON at most."""
    least, found = FREQUENT, {r["p"]: r["count"] for r in counts.where(F.col("rows") >= FREQUENT).groupBy(F.floor(F.log2("rows")).alias("p")).count().collect()}  # 63 at most
    while sum(n for p, n in found.items() if 2**p >= least) > MOST_COMMON:
        least *= 2
    got = counts.where(F.col("rows") >= least).toArrow()
    s, n = (np.asarray(got.column(c).to_numpy(), np.int64) for c in ("s", "rows"))
    at = np.minimum(np.searchsorted(common[0], s), max(0, len(common[0]) - 1))
    known = np.where(common[0][at] == s, common[1][at], 0) if len(common[0]) else np.zeros(len(s), np.int64)
    s, n = s[n > 2 * known], n[n > 2 * known]
    order = np.argsort(s)
    return s[order], n[order]


def _texts_with(nodes: DataFrame, rows: DataFrame, new: np.ndarray) -> DataFrame:
    """(text) of one row for each key whose prefix holds one of `new`, and of few others."""
    sc = nodes.sparkSession.sparkContext
    moved = sc.broadcast(new)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 4096):
            prefixes = b.column("prefix")
            hit = np.unique(pc.list_parent_indices(prefixes).to_numpy()[among(prefixes.flatten().to_numpy(), moved.value)])
            yield pa.RecordBatch.from_arrays([b.column("hash").take(pa.array(hit))], ["k"])

    bits = sc.broadcast(bitmap(nodes.select("hash", "prefix").mapInArrow(tidy(touched), "k bigint")))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            yield b.filter(pa.array(held(b.column("hash").to_numpy(), bits.value)))

    return rows.select("hash", "text").mapInArrow(tidy(chosen), "hash bigint, text string")


def _around(texts: DataFrame, new: np.ndarray) -> DataFrame:
    """(s): the distinct shingles within NEAR places of one of `new`, text by text."""
    moved = texts.sparkSession.sparkContext.broadcast(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            found = []
            for t in b.column("text").to_pylist():
                h = sequence(t)
                step = np.zeros(len(h) + 1, np.int64)
                at = np.flatnonzero(among(h, moved.value))
                np.add.at(step, np.maximum(at - NEAR, 0), 1)
                np.add.at(step, np.minimum(at + NEAR + 1, len(h)), -1)
                found.append(np.unique(h[np.cumsum(step)[:-1] > 0]))
            yield pa.RecordBatch.from_arrays([_lists(found)], ["s"])

    return texts.mapInArrow(tidy(run), "s array<bigint>").select(F.explode("s").alias("s"))


def _again(nodes: DataFrame, texts: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """`nodes` with the prefixes of `texts` in the order that `common` gives."""
    order = nodes.sparkSession.sparkContext.broadcast(common)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(key_of, sets), pa.int64()), _lists([prefix(s, *order.value) for s in sets])], ["fp", "anew"])

    anew = texts.mapInArrow(tidy(made), "fp bigint, anew array<bigint>").groupBy("fp").agg(F.first("anew").alias("anew"))
    return nodes.join(anew, "fp", "left").withColumn("prefix", F.coalesce("anew", "prefix")).drop("anew")


def shared_places(nodes: DataFrame, twice: DataFrame) -> DataFrame:
    """(s, fp, n, at): the places of the shingles `twice` (s), which is a checkpoint, as one too.

    A bitmap drops most other places before they are shuffled, and the join the rest."""
    shared = nodes.sparkSession.sparkContext.broadcast(bitmap(twice.select(F.col("s").alias("k")), _bits_for(twice.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 4096):
            prefixes = b.column("prefix")
            s, row = prefixes.flatten().to_numpy(), pc.list_parent_indices(prefixes).to_numpy()
            at = np.arange(len(s)) - (np.asarray(prefixes.offsets)[:-1] - prefixes.offsets[0].as_py())[row]
            keep = np.flatnonzero(held(s, shared.value))
            take = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([pa.array(s[keep]), b.column("fp").take(take), b.column("n").take(take), pa.array(at[keep], pa.int32())], ["s", "fp", "n", "at"])

    places = nodes.select("fp", "n", "prefix").mapInArrow(tidy(run), "s bigint, fp bigint, n int, at int")
    return checkpointed(places.join(twice.select("s"), "s"))


def _bits_for(keys: int) -> int:
    """Sixteen bits a key, in a power of two, and MOST_BITS at most, which bounds what is broadcast."""
    return min(MOST_BITS, max(1 << 20, 1 << (16 * keys).bit_length()))


def _freed(df: DataFrame) -> None:
    """Spark deletes shuffle files once the driver has collected what refers to them; this keeps a step's from adding to the next one's."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(u, v): pairs of keys whose components are those of all texts with fingerprints within two bits, by operator 8's links."""
    first = checkpointed(nodes.groupBy("sim").agg(F.min("fp").alias("first")))
    side = lambda c: first.select(F.col("sim").alias(c), F.col("first").alias(f"{c}_first"))
    near = simhash.links(first.select(F.col("sim").alias("fp"))).join(side("u"), "u").join(side("v"), "v")
    same = nodes.select("sim", "fp").join(first, "sim").where("fp <> first")
    pairs = near.select("u_first", "v_first").union(same.select("fp", "first")).toDF("a", "b")
    found = checkpointed(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    discarded(first)
    return found


def links(nodes: DataFrame, twice: DataFrame, rows: DataFrame) -> DataFrame:
    """(u, v): each key that has a lesser one in its component, and the least of it. `nodes`, a checkpoint, has fp, hash, n, prefix, counts and sim of each key."""
    alike = by_fingerprint(nodes)
    shared = shared_places(nodes, twice)
    discarded(twice)
    _freed(shared)
    pair = (F.greatest("fp", "other").alias("u"), F.least("fp", "other").alias("v"))
    room = lambda n, m: F.col(n) * 5 >= F.col(m) * 4

    def with_root(stars: DataFrame | None) -> DataFrame:
        if stars is None:
            return shared.withColumn("root", F.col("fp"))
        return shared.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))

    def joined(stars: DataFrame | None, met: DataFrame) -> DataFrame:
        """The components with what of `met` is similar."""
        new = verified(met, nodes, rows)
        out = components(new if stars is None else stars.unionByName(new))
        discarded(new, *([] if stars is None else [stars]))
        _freed(out)
        return out

    stars, open_, most = None, with_root(None), MANY * shared.count()
    for turn in range(STARS):
        chosen = open_.groupBy("s").agg(F.min_by(F.struct(F.col("fp").alias("other"), F.col("n").alias("m"), F.col("root").alias("its")), F.struct(F.col("at") / F.col("n"), F.xxhash64("fp", F.lit(turn)))).alias("c")).select("s", "c.*")
        met = open_.join(chosen, "s").where((F.col("root") != F.col("its")) & room("n", "m") & room("m", "n")).select(*pair)
        stars = joined(stars, (met if turn else met.unionByName(alike)).distinct())
        last, open_ = open_, checkpointed(with_root(stars))
        sizes = open_.groupBy("s", "root").agg(F.count(F.lit(1)).alias("rows")).groupBy("s")
        largest = sizes.agg(F.max_by("root", F.struct("rows", "root")).alias("most"), F.max("rows").alias("largest"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
        if turn:
            discarded(last)
        if (largest.agg(F.sum(F.expr("(rows - largest) * double(rows)"))).first()[0] or 0) <= most:
            break
    discarded(alike, shared)
    marked = open_.join(largest.select("s", "most"), "s").select("s", "fp", "n", "at", "root", (F.col("root") != F.col("most")).alias("out"))
    smaller = marked.where("at * 9 <= n").select("s", F.col("fp").alias("other"), F.col("n").alias("m"), F.col("at").alias("its_at"), F.col("root").alias("its"), F.col("out").alias("its_out"))
    fits = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("its_at")) * 9 >= (F.col("n") + F.col("m")) * 4
    between = (F.col("root") != F.col("its")) & (F.col("m") <= F.col("n")) & room("m", "n") & fits
    met = marked.where("out").join(smaller, "s").where(between).unionByName(marked.where("NOT out").join(smaller.where("its_out"), "s").where(between))
    met = met.select(*pair).distinct()
    out = joined(stars, met)
    discarded(open_)
    return out


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` of which one stays for each component of near copies, chosen as in simhash.one_of_each. All columns are kept."""
    rows = known(docs, id_col, text_col)
    common = common_shingles(rows)
    found = checkpointed(prints(rows, common))
    least = F.min_by(F.struct("hash", "n", "prefix", "counts", "sim"), "hash").alias("x")
    nodes = checkpointed(found.groupBy("fp").agg(least).select("fp", "x.*"))
    light = checkpointed(found.select("id", "hash", "fp"))
    discarded(found)
    _freed(nodes)
    nodes, twice = settled(nodes, rows, common)
    stars = links(nodes, twice, rows)
    roots = nodes.select("fp").join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return one_of_each(rows, light, roots)
