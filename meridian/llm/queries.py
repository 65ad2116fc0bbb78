"""The queries of this subpackage's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm.common import table


def op1_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.llm.hilbert_ann import search

    rows = table(spark, sf_dir, "embeddings")
    found = search(rows, rows.where("vec_id % 50 = 0"), k=5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.llm.bpe_codec import decode, encode

    return decode(encode(table(spark, sf_dir, "documents"))).select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.llm.hamming_topk import search, sign_code

    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    found = search(codes, codes.where("id % 20 = 0"), k=10)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "distance")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.llm.urls import judge

    return judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.llm.secrets import KINDS, scan

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.llm.common import fold_of
    from meridian.llm.quality import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs, table(spark, sf_dir, "labels"), folds=5, held_out=0)
    scored = docs.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), score(docs, weights).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.llm.common import checkpointed
    from meridian.llm.simhash import fingerprints, near_duplicates

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    prints = checkpointed(fingerprints(docs, ["id"]))
    classes = near_duplicates(prints).select("fp", "component_id")
    return prints.join(classes, "fp").select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.llm.token_counts import count_tokens

    counts = count_tokens(table(spark, sf_dir, "documents"))
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.llm.common import fold_of
    from meridian.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), folds=4, held_out=2)
    scored = docs.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith(("op", "pipeline")) and callable(f)}


#: Searches over all pairs, which is right for a check on a small table.
HAMMING_SQL = """
WITH codes AS (
  SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) BETWEEN 1 AND 64
), near AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.bits, r.bits), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM codes q JOIN codes r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM near
)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_hamming_topk": HAMMING_SQL}
