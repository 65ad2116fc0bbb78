"""Text of SQL and of models' answers, as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spellings of the complexity tiers that occur, and what they stand for.
LEVEL_SPELLINGS = {"Facíl": "Fácil", "Facil": "Fácil", "Medio": "Médio", "Dificil": "Difícil", "Muito Dificil": "Muito Difícil"}
DEFAULT_PROMPT = "Pergunta: {question}\nSQL:"

#: What counts as a token of SQL and as a call of a spatial function.
_TOKEN = r"(?U)[\w\.\*]+|<>|!=|>=|<=|[(),=<>!;]"
_GEO_CALL = r"\bst_[a-z0-9_]+(?=\s*\()"


def stripped(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalized(sql: Column) -> Column:
    """Comments dropped, lower case, white space collapsed, semicolons at the end dropped. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(sql, r"--[^\n]*", ""), r"(?s)/\*.*?\*/", "")
    return stripped(F.regexp_replace(F.regexp_replace(F.lower(stripped(bare)), r"(?U)\s+", " "), r";+$", ""))


def loosely_normalized(sql: Column) -> Column:
    """For exact-match rates: lower case, white space collapsed, one semicolon at the end dropped; comments stay."""
    return stripped(F.regexp_replace(F.regexp_replace(F.lower(stripped(sql)), r"(?U)\s+", " "), r";$", ""))


def tokens(sql: Column) -> Column:
    return F.regexp_extract_all(normalized(sql), F.lit(_TOKEN), F.lit(0))


def geo_calls(sql: Column) -> Column:
    """The st_* functions that are called, sorted, repeats kept."""
    return F.sort_array(F.regexp_extract_all(normalized(F.coalesce(sql, F.lit(""))), F.lit(_GEO_CALL), F.lit(0)))


def is_blank(c: Column) -> Column:
    return stripped(F.coalesce(c, F.lit(""))) == ""


def first_line(message: Column) -> Column:
    return F.substring_index(stripped(message), "\n", 1)


def fixed_level(level: Column) -> Column:
    """The tier's right spelling; others unchanged."""
    out = level
    for wrong, right in LEVEL_SPELLINGS.items():
        out = F.when(level == wrong, right).otherwise(out)
    return out


def prompt(question: Column, template: str = DEFAULT_PROMPT) -> Column:
    return F.replace(F.lit(template), F.lit("{question}"), question)


def metric_key(name: Column) -> Column:
    """A name with what metric names may not hold replaced by underscores."""
    return F.regexp_replace(name, r"[^A-Za-z0-9_\-./ ]", "_")


def version_label(path: Column) -> Column:
    """v<N> of a file name predictions_v<N>.json, else the name without its ending."""
    number = F.regexp_extract(path, r"_v(\d+)\.json$", 1)
    return F.when(number != "", F.concat(F.lit("v"), number)).otherwise(F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1))


def version_number(path: Column) -> Column:
    return F.regexp_extract(path, r"_v(\d+)\.json$", 1).try_cast("int")


def percent(x: Column, digits: int = 1) -> Column:
    return F.coalesce(F.concat(F.format_number(x * 100, digits), F.lit("%")), F.lit("n/a"))


def fixed(x: Column, digits: int = 4) -> Column:
    return F.coalesce(F.format_number(x, digits), F.lit("n/a"))


def extracted_sql(answer: Column) -> Column:
    """The query in a model's answer: the inside of the first closed fence (an open fence at the start loses its line),
    without the first run of [tags] that begins a line, from the first WITH or SELECT, cut after the first semicolon
    that more text follows. "" if there is none."""
    text = stripped(F.coalesce(answer, F.lit("")))
    # How answers fence and tag a query.
    closed = r"(?s)```(?:sql|SQL|postgresql)?\s*(.*?)```"
    opened = F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*(?:\n|$)", ""), r"\n[^\S\n]*```[^\n]*$", "")
    inside = F.when(text.rlike(closed), F.regexp_extract(text, closed, 1)).when(text.startswith("```"), opened).otherwise(text)
    # One substitution only, at the start of any line: everything before it is kept.
    tags = r"(?s)\A(.*?)(?m:^)\s*(?:\[[^\]\n]*\]\s*)+"
    untagged = F.regexp_replace(stripped(inside), tags, "$1")
    query = F.regexp_extract(untagged, r"(?is)\b((?:WITH|SELECT)\b.*)$", 1)
    return stripped(F.regexp_replace(query, r"(?s);\s*\S.*$", ";"))


# -- multisets


def numbered(items: Column) -> Column:
    """The items, each with its number among equal ones; sets of these intersect as the multisets do."""
    each = lambda s: F.transform(s, lambda x, i: F.struct(x.alias("item"), (i + 1 - F.array_position(s, x)).cast("int").alias("n")))
    return F.transform(F.array(F.sort_array(items)), each)[0]


def common_size(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(numbered(a), numbered(b)))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return safe_ratio(F.lit(2.0) * p * r, p + r)


def overlap(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Precision, recall and F1 of multiset a against b, rounded to 4 places, with tp, fp and fn."""
    once = F.array(F.struct(a.alias("a"), b.alias("b")))  # so that each side is worked out once
    counted = F.transform(once, lambda s: F.struct(common_size(s["a"], s["b"]).alias("tp"), F.size(s["a"]).alias("n"), F.size(s["b"]).alias("m")))

    def scored(c: Column) -> Column:
        empty = (c["n"] == 0) & (c["m"] == 0)
        p, r = safe_ratio(c["tp"].cast("double"), c["n"].cast("double")), safe_ratio(c["tp"].cast("double"), c["m"].cast("double"))
        value = lambda x: F.when(empty, F.lit(both_empty)).otherwise(F.round(x, 4))
        return F.struct(value(p).alias("precision"), value(r).alias("recall"), value(f1(p, r)).alias("f1"), c["tp"].alias("tp"), (c["n"] - c["tp"]).alias("fp"), (c["m"] - c["tp"]).alias("fn"))

    return F.transform(counted, scored)[0]


def jaccard(a: Column, b: Column) -> Column:
    """Of sets of items; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(safe_ratio(F.size(F.array_intersect(a, b)).cast("double"), union.cast("double")))


def token_scores(predicted: Column, gold: Column) -> Column:
    return overlap(tokens(F.coalesce(predicted, F.lit(""))), tokens(F.coalesce(gold, F.lit(""))))


def geo_scores(predicted: Column, gold: Column) -> Column:
    return overlap(geo_calls(predicted), geo_calls(gold), both_empty=1.0)


@F.arrow_udf(T.DoubleType())
def _ratio(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in batches:
        yield pa.array([1.0 if x == y else round(SequenceMatcher(None, x, y).ratio(), 4) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def similarity(predicted: Column, gold: Column) -> Column:
    """The matching-blocks ratio of the normalised texts, whole whatever their lengths."""
    a, b = (normalized(F.coalesce(c, F.lit(""))) for c in (predicted, gold))
    return _ratio(a, b)
