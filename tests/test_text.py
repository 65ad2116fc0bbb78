import difflib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from meridian.functions import text
from meridian.operators.score import comparable, long_form, score_pairs

ANSWERS = {
    "Sure:\n```sql\nSELECT 1;\n```\nbye": "SELECT 1;",
    "```\nselect a from t\n": "select a from t",
    "```sql\nselect a from t\n``` ": "select a from t",
    "[Divisão: UF] [x] SELECT a FROM t": "SELECT a FROM t",
    "intro\n[tag] SELECT a": "SELECT a",
    "The query is: WITH x AS (SELECT 1) SELECT * FROM x": "WITH x AS (SELECT 1) SELECT * FROM x",
    "SELECT a; this lists a": "SELECT a;",
    "SELECT 'a;b' FROM t": "SELECT 'a;",
    "SELECT a FROM t;  ": "SELECT a FROM t;",
    "no query": "", "": "", None: "", "   ": "",
}


def values(spark, rows, column, schema="a string, b string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_extraction(spark):
    assert values(spark, [(a, None) for a in ANSWERS], text.extracted_sql(F.col("a"))) == list(ANSWERS.values())


def test_normalisation(spark):
    cases = {"  SELECT  A -- note\nFROM t /* x\ny */ ;; ": "select a from t", "SELECT Município": "select município", "": "", "a  b;": "a b"}
    assert values(spark, [(a, None) for a in cases], text.normalized(F.col("a"))) == list(cases.values())
    assert values(spark, [("SELECT A;; ", None)], text.loosely_normalized(F.col("a"))) == ["select a;"]


PAIRS = [("select a, a from t where x >= 1", "SELECT a FROM t WHERE x >= 2;"), ("", "select 1"), ("select ST_Within(a, b), st_within (c, d), st_x", "select ST_Within(a,b), ST_Intersects(a,b)"), ("same", "same")]


def tokens(sql):
    sql = re.sub(r"\s+", " ", sql.strip().lower()).rstrip(";").strip()
    return sql, re.findall(r"[\w\.\*]+|<>|!=|>=|<=|[(),=<>!;]", sql)


def test_token_scores_and_similarity(spark):
    got = values(spark, PAIRS, F.struct(text.token_scores(F.col("a"), F.col("b")).alias("t"), text.similarity(F.col("a"), F.col("b")).alias("s")))
    for (a, b), r in zip(PAIRS, got, strict=True):
        (x, p), (y, g) = tokens(a), tokens(b)
        common = sum((Counter(p) & Counter(g)).values())
        assert r.t.tp == common and r.t.precision == (round(common / len(p), 4) if p else 0.0) and r.t.recall == round(common / len(g), 4)
        assert r.s == round(difflib.SequenceMatcher(None, x, y).ratio(), 4)


def test_similarity_of_long_texts(spark):
    long = "select " + ", ".join(f"c{i}" for i in range(5000)) + " from t"
    pairs = [(long, long), (long, long.replace("c77,", "d77,"))]
    got = values(spark, pairs, text.similarity(F.col("a"), F.col("b")))
    assert len(long) > 20_000 and got == [1.0, round(difflib.SequenceMatcher(None, *pairs[1]).ratio(), 4)]


def test_geo_scores(spark):
    got = values(spark, PAIRS + [(None, None)], text.geo_scores(F.col("a"), F.col("b")))
    assert [(r.tp, r.fp, r.fn, r.f1) for r in got] == [(0, 0, 0, 1.0), (0, 0, 0, 1.0), (1, 1, 1, 0.5), (0, 0, 0, 1.0), (0, 0, 0, 1.0)]


def test_small_functions(spark):
    df = spark.createDataFrame([("predictions_v10.json", 0.5), ("other.json", None)], "p string, x double")
    rows = df.select(text.version_label(F.col("p")), text.version_number(F.col("p")), text.percent(F.col("x")), text.fixed(F.col("x"), 2), text.safe_ratio(F.col("x"), F.lit(0.0))).collect()
    assert [tuple(r)[:4] for r in rows] == [("v10", 10, "50.0%", "0.50"), ("other", None, "n/a", "n/a")] and rows[0][4] == 0.0


def test_scored_records(spark):
    schema = "sql_validation_id string, nivel string, sql_code_gold string, sql_code_base string, sql_code_finetuned string"
    rows = [("1", "Fácil", "SELECT a FROM t", "", "select A from T"), ("2", None, "SELECT a FROM t", None, " "), ("3", "Médio", "SELECT a FROM t", "SELEC", "SELECT b FROM t")]
    kept = comparable(spark.createDataFrame(rows, schema))
    assert kept.count() == 2
    scored = {(r.id, r.model): r for r in score_pairs(long_form(kept)).collect()}
    assert scored["1", "finetuned"].ast_equivalent and scored["1", "finetuned"].string_exact and scored["1", "finetuned"].failures == ["correct"]
    assert scored["1", "base"].component_jaccard == 0.0 and scored["1", "base"].failures == ["parse_error"]
    assert scored["3", "finetuned"].failures == ["wrong_columns"] and scored["3", "finetuned"].division == ""
    legacy = {(r.id, r.model): r for r in score_pairs(long_form(kept), legacy=True).collect()}
    assert legacy["3", "base"].component_jaccard == 1.0 and legacy["1", "base"].component_jaccard == 0.0


def test_execution_joins_back(spark):
    pairs = spark.createDataFrame([("select 1", "select 1"), ("", "select 1")], "predicted string, gold string")
    execution = spark.createDataFrame([("select 1", "select 1", True, True, True, None), ("", "select 1", None, False, True, "empty sql")], "predicted string, gold string, execution_match boolean, executable boolean, gold_executable boolean, execution_error string")
    got = {r.predicted: r for r in score_pairs(pairs, execution).collect()}
    assert got["select 1"].execution_match is True and got[""].execution_match is False


@pytest.mark.parametrize("wrong,right", list(text.LEVEL_SPELLINGS.items()) + [("Fácil", "Fácil"), ("x", "x"), (None, None)])
def test_levels(spark, wrong, right):
    assert values(spark, [(wrong, None)], text.fixed_level(F.col("a"))) == [right]
