"""Scores predicted SQL against gold SQL, a row for each pair.

Text and spatial measures are Column expressions; trees need a parser, an Arrow function. All of them follow from a pair's
two texts, so each pair that occurs is measured once, however many rows have it, and its measures are joined back. Texts
that are too long are told before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions import text
from meridian.plans import sql_compare

MODELS = ("base", "finetuned")
COMPONENTS = "map<string,struct<match:boolean,jaccard:double>>"
TREE = f"struct<ast_equivalent:boolean,structural_precision:double,structural_recall:double,structural_f1:double,component_jaccard:double,components:{COMPONENTS},parse_error:string,failures:array<string>>"
_TREE_ARROW = pa.struct([
    ("ast_equivalent", pa.bool_()), *((f"structural_{x}", pa.float64()) for x in ("precision", "recall", "f1")), ("component_jaccard", pa.float64()),
    ("components", pa.map_(pa.string(), pa.struct([("match", pa.bool_()), ("jaccard", pa.float64())]))), ("parse_error", pa.string()), ("failures", pa.list_(pa.string())),
])


def tree_scores(predicted: Column, gold: Column, execution_error: Column | None = None, legacy: bool = False) -> Column:
    """The measures of two texts' trees; see meridian.plans.sql_compare.score. Errors of the parser's own become scoring_error."""

    @F.arrow_udf(TREE)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            out = []
            for p, g, e in zip(*(c.to_pylist() for c in columns), strict=True):
                try:
                    row = sql_compare.score(p, g, bool(e), legacy)
                except Exception as error:  # one pair never ends the run
                    row = {**sql_compare.score("", "", legacy=legacy), "parse_error": str(error)[:200], "failures": ["scoring_error"]}
                out.append(row | {"components": list(row["components"].items())})
            yield pa.array(out, _TREE_ARROW)

    return run(predicted, gold, execution_error if execution_error is not None else F.lit(False))


def long_form(records: DataFrame) -> DataFrame:
    """Prediction records (wide) as a row for each record and model: id, level, division, question, gold, model, predicted.

    Missing and null fields count as "". Portuguese and English names of the columns are known."""
    have = {c.lower() for c in records.columns}
    pick = lambda *names: F.coalesce(*(F.col(n).cast("string") for n in names if n in have), F.lit(""))
    wide = records.select(
        pick("sql_validation_id", "id").alias("id"), pick("nivel", "level").alias("level"), pick("divisao", "territorial_division").alias("division"),
        pick("funcao", "geospatial_functions").alias("function"), pick("question", "pergunta").alias("question"), pick("sql_code_gold").alias("gold"),
        pick("sql_code_base").alias("b"), pick("sql_code_finetuned").alias("f"),
    )
    return wide.select("id", "level", "division", "function", "question", "gold", F.expr("stack(2, 'base', b, 'finetuned', f) AS (model, predicted)"))


def comparable(records: DataFrame, all_records: bool = False) -> DataFrame:
    """Records with SQL of at least one model."""
    return records if all_records else records.where(~text.is_blank(F.col("sql_code_base")) | ~text.is_blank(F.col("sql_code_finetuned")))


def score_pairs(pairs: DataFrame, execution: DataFrame | None = None, legacy: bool = False) -> DataFrame:
    """`pairs` (columns predicted and gold, and any others) with all measures.

    `execution` has rows (predicted, gold, execution_match, executable, gold_executable, execution_error), one for each
    pair. A blank prediction matches nothing: its component score is 0 and, where the gold query was run, so is its match."""
    if execution is None:
        kinds = {"execution_match": "boolean", "executable": "boolean", "gold_executable": "boolean", "execution_error": "string"}
        rows = pairs.select("*", *(F.lit(None).cast(t).alias(n) for n, t in kinds.items()))
    else:
        rows = pairs.join(execution, ["predicted", "gold"], "left")
    failed = F.col("execution_error").isNotNull()
    keys = ["predicted", "gold", "failed"]
    rows = rows.withColumn("failed", failed)
    p, g = F.col("predicted"), F.col("gold")
    blank = text.is_blank(p)
    measures = {
        "tree": tree_scores(p, g, F.col("failed"), legacy), "string_exact": text.normalized(F.coalesce(p, F.lit(""))) == text.normalized(F.coalesce(g, F.lit(""))),
        "string_similarity": text.similarity(p, g), "token": text.token_scores(p, g), "geo": text.geo_scores(p, g), "predicted_functions": text.geo_calls(p), "gold_functions": text.geo_calls(g),
    }
    measured = rows.select(*keys).distinct().select(*keys, F.struct(*(c.alias(n) for n, c in measures.items())).alias("measured"))
    measured = measured.withColumnsRenamed({k: f"__{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    scored = rows.join(measured, match[0] & match[1] & match[2], "left").drop(*(f"__{k}" for k in keys), "failed")
    tree = F.col("measured.tree")
    return scored.select(
        *[c for c in scored.columns if c not in ("measured", "execution_match")],
        F.when(blank & F.col("gold_executable"), F.coalesce("execution_match", F.lit(False))).otherwise(F.col("execution_match")).alias("execution_match"),
        *(tree[x].alias(x) for x in ("ast_equivalent", "structural_precision", "structural_recall", "structural_f1", "components", "parse_error", "failures")),
        F.when(blank, 0.0).otherwise(tree["component_jaccard"]).alias("component_jaccard"),
        *(F.col(f"measured.{x}").alias(x) for x in ("string_exact", "string_similarity", "token", "geo")),
        (F.col("measured.predicted_functions") == F.col("measured.gold_functions")).alias("spatial_exact"),
        *(F.col(f"measured.{x}").alias(x) for x in ("predicted_functions", "gold_functions")),
    )


def report_json(scored: DataFrame) -> DataFrame:
    """`scored` with a column report: the nested report of a pair as JSON text."""
    summary = F.struct("ast_equivalent", "execution_match", F.col("component_jaccard").alias("component_avg_jaccard"), "string_exact", "string_similarity", F.col("token.f1").alias("token_f1"), F.col("geo.f1").alias("geospatial_f1"), "spatial_exact", "failures")
    body = F.struct(
        summary.alias("summary"), F.struct(F.col("ast_equivalent").alias("equivalent"), "parse_error").alias("ast"),
        F.struct(*(F.col(f"structural_{x}").alias(x) for x in ("precision", "recall", "f1"))).alias("structural_f1"),
        F.struct(F.col("execution_match").alias("match"), F.col("execution_error").alias("error")).alias("execution"), F.col("components"),
        F.struct(F.col("string_exact").alias("exact"), F.col("string_similarity").alias("similarity"), F.struct("token.precision", "token.recall", "token.f1").alias("token_f1")).alias("string"),
        F.struct("geo.*", "spatial_exact", "predicted_functions", "gold_functions").alias("geospatial"),
    )
    return scored.withColumn("report", F.to_json(body, {"ignoreNullFields": "false"}))
