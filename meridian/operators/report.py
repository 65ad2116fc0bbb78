"""Aggregates of scored pairs: by scope, by spatial function, by failure; deltas, flat metrics and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions import text

#: Names of the summary's means and what each averages.
MEANS = {
    "execution_accuracy": "execution_match", "executable_rate": "executable", "ast_equivalence": "ast_equivalent", "structural_precision": "structural_precision", "structural_recall": "structural_recall",
    "structural_f1": "structural_f1", "component_jaccard": "component_jaccard", "string_exact": "string_exact", "string_similarity": "string_similarity", "token_precision": "token.precision",
    "token_recall": "token.recall", "token_f1": "token.f1", "geospatial_precision": "geo.precision", "geospatial_recall": "geo.recall", "geospatial_f1": "geo.f1", "spatial_exact_match": "spatial_exact",
}


def mean(c: Column) -> Column:
    """To 4 places; null where there is nothing to average."""
    return F.round(F.avg(c.cast("double")), 4)


def summary(scored: DataFrame) -> DataFrame:
    """A row for each scope (overall, level, division), value and model: n, the means, and sums of spatial calls.

    One pass with grouping sets. An execution match counts only where the gold query can be executed."""
    values = {n: F.when(F.col("gold_executable"), F.col("execution_match")) if n == "execution_accuracy" else F.col(c) for n, c in MEANS.items()}
    flat = scored.select("model", "level", "division", *(v.cast("double").alias(n) for n, v in values.items()), *(F.col(f"geo.{x}").alias(f"geo_{x}") for x in ("tp", "fp", "fn")))
    totals = [F.count(F.lit(1)).alias("n"), *(mean(F.col(n)).alias(n) for n in MEANS), *(F.sum(f"geo_{x}").alias(f"geo_{x}") for x in ("tp", "fp", "fn"))]
    sets = [[F.col("model")], [F.col("model"), F.col("level")], [F.col("model"), F.col("division")]]
    grouped = flat.groupingSets(sets, "model", "level", "division").agg(F.grouping_id().alias("__set"), *totals)
    scope = F.when(F.col("__set") == 3, "overall").when(F.col("__set") == 1, "level").otherwise("division")
    out = grouped.select(scope.alias("scope"), F.coalesce("level", "division", F.lit("")).alias("value"), "model", *(c for c in grouped.columns if c not in ("__set", "model", "level", "division")))
    named = flat.where("division <> ''").limit(1).isEmpty()
    return out if named else out.where("NOT (scope = 'division' AND value = '')")


def per_function(scored: DataFrame) -> DataFrame:
    """TP, FP, FN, gold queries, precision, recall and F1 of each spatial function and model."""
    both = scored.select("model", F.transform(F.array_distinct(F.concat("predicted_functions", "gold_functions")), lambda f: F.struct(
        f.alias("function"), F.size(F.filter("predicted_functions", lambda x: x == f)).alias("p"), F.size(F.filter("gold_functions", lambda x: x == f)).alias("g"))).alias("calls"))
    calls = both.select("model", F.explode("calls").alias("c")).select("model", "c.*")
    least = F.least("p", "g")
    sums = calls.groupBy("model", "function").agg(F.sum(least).alias("tp"), F.sum(F.col("p") - least).alias("fp"), F.sum(F.col("g") - least).alias("fn"), F.sum((F.col("g") > 0).cast("int")).alias("gold_queries"))
    p, r = text.safe_ratio(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), text.safe_ratio(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double"))
    return sums.select("*", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(text.f1(p, r), 4).alias("f1"))


def failure_counts(scored: DataFrame, top: int | None = None) -> DataFrame:
    """How often each label occurs for each model, the most frequent first; of each model the `top` most frequent, if given."""
    counts = scored.select("model", F.explode("failures").alias("label")).groupBy("model", "label").agg(F.count(F.lit(1)).alias("n"))
    if top is not None:
        place = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("n"), "label"))
        counts = counts.withColumn("__place", place).where(F.col("__place") <= top).drop("__place")
    return counts.orderBy(F.desc("n"), "model", "label")


def deltas(totals: DataFrame, metric: str) -> DataFrame:
    """Fine-tuned less base of a metric for each scope and value."""
    wide = totals.groupBy("scope", "value").pivot("model", ["base", "finetuned"]).agg(F.first(metric))
    return wide.select("scope", "value", F.round(F.col("finetuned") - F.col("base"), 4).alias("delta"))


def headline(db_used: bool) -> str:
    return "execution_accuracy" if db_used else "ast_equivalence"


def flat_metrics(totals: DataFrame) -> DataFrame:
    """(name, value) of every metric of a summary, names like level/Fácil/base/token_f1, without nulls."""
    names = [c for c in totals.columns if c not in ("scope", "value", "model")]
    entries = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("number")) for n in names))).alias("m")
    path = F.concat_ws("/", "scope", F.when(F.col("value") != "", F.col("value")), "model", "m.metric")
    return totals.select("scope", "value", "model", entries).where("m.number IS NOT NULL").select(text.metric_key(path).alias("name"), F.col("m.number").alias("value"))


def exact_match(predictions: DataFrame, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """Exact-match rates by model and level, and over all levels (level null), by rollup."""
    same = (text.loosely_normalized(F.coalesce(F.col(predicted), F.lit(""))) == text.loosely_normalized(F.coalesce(F.col(gold), F.lit("")))).cast("int")
    return predictions.withColumn("same", same).groupingSets([[F.col("model")], [F.col("model"), F.col("level")]], "model", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("same").alias("matches"), F.round(F.avg("same"), 4).alias("rate"))


def compared_with(published: DataFrame, run: DataFrame) -> DataFrame:
    """A published table (metric, base, finetuned) beside a run's, by metric name; metrics that the run lacks stay, with nulls."""
    ours = run.withColumnsRenamed({"base": "run_base", "finetuned": "run_finetuned"})
    both = published.join(ours, "metric", "left")
    return both.select("metric", "base", "run_base", F.round(F.col("run_base") - F.col("base"), 4).alias("delta_base"), "finetuned", "run_finetuned", F.round(F.col("run_finetuned") - F.col("finetuned"), 4).alias("delta_finetuned"))


def cross_experiment(summaries: DataFrame, metric: str) -> DataFrame:
    """A row for each experiment: the metric of both models over all pairs, and its delta."""
    wide = summaries.where("scope = 'overall'").groupBy("experiment").pivot("model", ["base", "finetuned"]).agg(F.first(metric))
    return wide.withColumn("delta", F.round(F.col("finetuned") - F.col("base"), 4)).orderBy("experiment")


def markdown(table: DataFrame, title: str = "", most: int = 1000) -> str:
    """A small report table as Markdown; more than `most` rows are refused."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a Markdown report has {most} rows at most")
    cell = lambda v: "n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"# {title}", ""] if title else []
    lines += ["| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def best_checkpoint(log: DataFrame, loss: str = "eval_loss") -> DataFrame:
    """The row of least loss; ties go to the earlier step."""
    return log.where(F.col(loss).isNotNull()).agg(F.min_by(F.struct("*"), F.struct(loss, "step")).alias("best")).select("best.*")


def parameter_counts(parameters: DataFrame) -> DataFrame:
    """Total and trainable numbers of a table (count, trainable), and the percentage."""
    sums = parameters.agg(F.sum("count").alias("total"), F.coalesce(F.sum(F.when(F.col("trainable"), F.col("count"))), F.lit(0)).alias("trainable"))
    return sums.withColumn("percent", F.round(100.0 * text.safe_ratio(F.col("trainable").cast("double"), F.col("total").cast("double")), 4))
