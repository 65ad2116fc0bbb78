import json

import pytest
from pyspark.sql import functions as F

from meridian import queries
from meridian.functions import console
from meridian.operators import compare, report, score, sequences, split
from meridian.plans import execute
from meridian.plans.dialect import to_spark
from meridian.sources import files
from meridian.streaming import scoring


def rows(spark, values):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(values)], "i long, a string, b int")
    return df.withColumnRenamed("i", compare.INDEX)


GOLD = [("Manaus", 10), ("Tefé", 5), ("Coari", 5)]


@pytest.mark.parametrize("predicted,expected", [
    (GOLD, (True, True, True)), ([GOLD[0], GOLD[2], GOLD[1]], (True, False, True)), ([GOLD[1], GOLD[0], GOLD[2]], (True, False, False)), (GOLD[:2], (False, False, False)),
])
def test_tie_breaks(spark, predicted, expected):
    a, b = rows(spark, predicted), rows(spark, GOLD)
    assert tuple(compare.same(a, b, m, [1]) for m in ("multiset", "list", "ordered_robust")) == expected


def test_comparison_widens_types_and_knows_nulls(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "k int, v string")
    b = spark.sql("SELECT CAST(k AS DECIMAL(10,2)) AS other, v FROM VALUES (2, 'x'), (1, NULL) t(k, v)")
    assert compare.same_multiset(a, b) and compare.same_set(a, b.union(b)) and not compare.same_multiset(a, b.union(b))
    assert not compare.same_set(a, a.select("k")) and compare.same_multiset(a.where("false"), b.where("false"))
    arrays = spark.sql("SELECT array(1, 2) AS x")
    assert compare.same_multiset(arrays, arrays) and not compare.same_multiset(arrays, spark.sql("SELECT array(2, 1) AS x"))


def test_modes():
    assert compare.mode_by_text("select a over (order by b)", "auto_text") == "list" and compare.mode_by_text("select 1", "auto_text") == "multiset"
    assert compare.mode_by_keys("select a from t order by a", "auto_robust") == ("ordered_robust", [0]) and compare.mode_by_keys("select * from t order by a", "auto_robust")[0] == "multiset"


def test_balanced_split(spark):
    cells = [(f"{a}{b}{c}{i:02}", a, b, c) for a in "WXYZ" for b in "ABCDEFG" for c in "abcdefg" for i in range(5)]
    df = split.stratified(spark.createDataFrame(cells, "id string, level string, function string, division string"), ["level", "function", "division"], "id", 0.2)
    val, train = df.where("validation"), df.where("NOT validation")
    assert (train.count(), val.count()) == (784, 196) and split.disjoint(train, val, "id")
    counts = {(r.column, r.n) for r in split.balance(val, ["level", "function", "division"]).collect()}
    assert counts == {("level", 49), ("function", 28), ("division", 28)}
    m = split.manifest(train, val, ["level"], 42, 0.2)
    assert m["validation"]["by_level"] == dict.fromkeys("WXYZ", 49)
    assert split.fingerprint(df)["digest"] == split.fingerprint(df.repartition(7))["digest"] != split.fingerprint(df.where("id <> 'WAa00'"))["digest"]


def test_rewriting(spark):
    spark.createDataFrame([(1, 2.5, None), (2, 1.5, "b"), (2, 0.5, "a")], "k int, x double, s string").createOrReplaceTempView("rewriting")
    run = lambda sql: [tuple(r) for r in spark.sql(to_spark(sql)).collect()]
    assert run("SELECT DISTINCT ON (k) k, x FROM rewriting ORDER BY k, x DESC") == [(1, 2.5), (2, 1.5)]
    assert run("SELECT s FROM rewriting ORDER BY s") == [("a",), ("b",), (None,)] and run("SELECT s FROM rewriting ORDER BY s DESC LIMIT 1") == [(None,)]
    assert run("SELECT 7 / 2 AS a, 12.3456::numeric(10,2)::text AS b, 'x' ~* 'X' AS c, 2 ^ 3 AS d") == [(3, "12.35", True, 8.0)]
    assert run("SELECT string_agg(s, ',') AS a, EXTRACT(year FROM DATE '2020-05-01') AS y, strpos('abc', 'c') AS p, (ARRAY[5, 6])[2] AS e FROM rewriting WHERE k = 2 AND s = 'a'") == [("a", 2020, 3, 6)]
    assert run('SELECT "k" FROM rewriting WHERE s IS NOT NULL AND x BETWEEN 1 AND 2') == [(2,)]


def test_gate(spark):
    assert execute.executable(spark, "SELECT 1")[0] and not execute.executable(spark, "")[0]
    for sql in ("DROP TABLE x", "INSERT INTO t SELECT 1", "CREATE VIEW v AS SELECT 1", "SELECT nothing FROM nowhere", "SET a = b"):
        ok, error = execute.executable(spark, sql)
        assert not ok and error and "\n" not in error


def test_timeout(spark):
    slow = spark.range(0, 200_000_000_000, 1, 4).select(F.sum(F.sqrt(F.col("id").cast("double"))))
    with pytest.raises(execute.TimedOut):
        execute.limited(spark, slow.collect, 1.0)
    assert execute.limited(spark, lambda: spark.range(3).count(), 30.0) == 3


def test_sequences(spark):
    df = spark.createDataFrame([(0, [1, 2, 3], [4, 5]), (1, [1], [9])], "id int, p array<int>, a array<int>")
    df = df.select("id", sequences.joined(F.col("p"), F.col("a"), 2, 5).alias("ids"), F.size("p").alias("n"))
    got = {r.id: r for r in sequences.padded_batches(sequences.batched(df, 2, ["id"]), "ids", "n", 0).collect()}
    assert got[0].ids == [1, 2, 3, 4, 5] and got[0].labels == [-100, -100, -100, 4, 5, -100, -100, -100]
    assert got[1].input_ids == [1, 9, 2, 0, 0, 0, 0, 0] and got[1].attention_mask == [1, 1, 1, 0, 0, 0, 0, 0]


def test_inference_falls_back(spark):
    def predict(questions):
        if "bad" in questions:
            raise RuntimeError
        return [q.upper() for q in questions]

    df = spark.createDataFrame([("a",), ("b",), ("bad",), ("c",)], "question string").coalesce(1)
    assert [r.raw_output for r in sequences.inferred(df, predict, size=2).collect()] == ["A", "B", "", ""]


def test_reports(spark):
    table = spark.createDataFrame([("a", 0.5), ("b|c", None)], "metric string, value double")
    assert report.markdown(table, "T") == "# T\n\n| metric | value |\n|---|---|\n| a | 0.5000 |\n| b\\|c | n/a |\n"
    with pytest.raises(ValueError):
        report.markdown(spark.range(5), most=3)
    s = spark.createDataFrame([("overall", "", m, e, x) for e, m, x in (("v1", "base", 0.1), ("v1", "finetuned", 0.3), ("v2", "base", 0.2))], "scope string, value string, model string, experiment string, x double")
    assert [tuple(r) for r in report.cross_experiment(s, "x").collect()] == [("v1", 0.1, 0.3, 0.2), ("v2", 0.2, None, None)]


def test_prediction_files(spark, tmp_path):
    for v in (10, 2):
        (tmp_path / f"predictions_v{v}.json").write_text(json.dumps([{"sql_validation_id": f"{v}-{i}", "sql_code_gold": "SELECT a FROM t", "sql_code_base": "", "sql_code_finetuned": "select a from t", "extra": 1} for i in range(3)]))
    paths = files.discover_predictions(spark, f"{tmp_path}/predictions_v*.json")
    assert [p.rsplit("/", 1)[1] for p in paths] == ["predictions_v2.json", "predictions_v10.json"] and files.ordered_versions([*paths, paths[0]]) == paths
    df = files.read_predictions(spark, paths)
    assert {(r.experiment, r["count"]) for r in df.groupBy("experiment").count().collect()} == {("v2", 3), ("v10", 3)}
    query = scoring.score_stream(scoring.arriving(spark, str(tmp_path)), f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination(120)
    scored = spark.read.parquet(f"{tmp_path}/out")
    assert scored.count() == 12 and scored.where("ast_equivalent").count() == 6


def test_files(spark, tmp_path):
    (tmp_path / "c.yaml").write_text('# c\nname: "a b"\nn: 3\nrate: 1e-3\non: true\nempty:\nitems: [q, v]\nmore:\n  - x\n  - y\n')
    c = files._flat_yaml((tmp_path / "c.yaml").read_text())
    assert c == {"name": "a b", "n": 3, "rate": 0.001, "on": True, "empty": None, "items": ["q", "v"], "more": ["x", "y"]}
    df = spark.createDataFrame([("1", "q", "Facil", "s", 1, "base"), ("2", "q", "Medio", "s", 0, "other")], "id string, pergunta string, level string, sql_code string, train int, source string")
    df.write.partitionBy("source").parquet(f"{tmp_path}/working")
    assert [r.level for r in files.dataset(spark, str(tmp_path), part="train").collect()] == ["Fácil"] and files.corpus(spark, f"{tmp_path}/working", "other").count() == 1
    with pytest.raises(FileNotFoundError):
        files.dataset(spark, str(tmp_path), "paper_split")
    with pytest.raises(ValueError):
        files.require_columns(df, "id", "nothing")
    df.drop("pergunta").write.option("header", True).csv(f"{tmp_path}/t.csv")
    assert files.read_table(spark, f"{tmp_path}/t.csv").count() == 2
    files.save_run_id(str(tmp_path / "r"), " abc ")
    assert files.load_run_id(str(tmp_path / "r")) == "abc" and files.load_run_id(str(tmp_path / "none")) is None
    assert files.masked_uri("postgresql://u:secret@h/db") == "postgresql://u:****@h/db"
    audit = execute.audit(spark, spark.createDataFrame([("1", "e", "SELECT 1"), ("2", "e", "SELECT x")], "id string, level string, sql_code string"))
    assert {r.status: r["count"] for r in execute.status_counts(audit).collect()} == {"ok": 1, "error": 1}
    files.write_failures(audit, f"{tmp_path}/failures")
    assert [r.id for r in files.read_table(spark, f"{tmp_path}/failures/*.csv").collect()] == ["2"]
    assert files.consolidated({"v1": df, "v2": df}).count() == 4


def test_console():
    assert console.padded("\x1b[31mab\x1b[0m", 4) == "\x1b[31mab\x1b[0m  " and console.progress_bar(2.0, 4) == "####" and console.progress_bar(-1, 4) == "...."
    assert console.badge(None) == "n/a" and console.marked("correct")[0] == "✔" and console.marked("wrong_limit")[0] == "~" and console.marked("parse_error")[0] == "✘"
    assert console.width("日本") == 4 and console.width("e\u0301") == 1 and console.failures_line(["wrong_limit", "unknown"]) == "Failures: ~ wrong_limit  ? unknown"
    assert console.components_table({"where": {"match": False, "jaccard": 0.5}}).split("\n") == ["clause  match  jaccard", "where   no     0.5000"]
    assert console.table([{"a": 1.5, "b": None}], ["a", "b"]).split("\n")[1] == "1.5000  n/a"
    t = console.Throttle(60)
    assert [t.due(1, 9), t.due(2, 9), t.due(9, 9)] == [True, False, True]


def test_severity_of_all_labels():
    from meridian.plans.sql_compare import LABELS, severity

    soft = {"missing_distinct", "wrong_order_by", "wrong_limit", "wrong_join_condition", "wrong_condition_value", "execution_error"}
    other = {"correct": "none", "unknown": "unknown", "scoring_error": "unknown"}
    assert {x: severity(x) for x in LABELS} == {x: other.get(x, "soft" if x in soft else "hard") for x in LABELS}


def test_component_mean_is_of_rounded_values():
    from meridian.plans.sql_compare import score

    s = score("SELECT a, b FROM t WHERE x = 1", "SELECT a, b, c FROM t WHERE x = 1")
    assert s["component_jaccard"] == round((round(2 / 3, 4) + 1 + 1) / 3, 4)


def test_split_is_written_with_its_manifest(spark, tmp_path):
    import json

    from meridian.operators import split
    from meridian.sources import files

    df = split.stratified(spark.range(100).selectExpr("id", "id % 4 AS k"), ["k"], "id", 0.2)
    train, val = (df.where(c).drop("validation") for c in ("NOT validation", "validation"))
    files.write_split(train, val, split.manifest(train, val, ["k"], 42, 0.2), str(tmp_path / "s"))
    m = json.loads((tmp_path / "s" / "split_manifest.json").read_text())
    assert m["train"]["rows"] == 80 and len(m["train_md5"]) == len(m["validation_md5"]) == 32 and m["train_md5"] != m["validation_md5"]
    assert spark.read.parquet(str(tmp_path / "s" / "validation")).count() == 20


def test_paths_that_resolve_alike_count_once(tmp_path):
    from meridian.sources import files

    (tmp_path / "d").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "d")
    paths = [f"{tmp_path}/d/predictions_v2.json", f"{tmp_path}/link/predictions_v2.json", f"file://{tmp_path}/d/../d/predictions_v2.json", "s3://b//x/./predictions_v1.json", "s3://b/x/predictions_v1.json"]
    assert files.ordered_versions(paths) == ["s3://b//x/./predictions_v1.json", paths[0]]


def test_top_labels(spark):
    from meridian.operators import report

    df = spark.createDataFrame([("m", ["a", "b"]), ("m", ["a", "c"]), ("m", ["c", "a"])], "model string, failures array<string>")
    assert [(r.label, r.n) for r in report.failure_counts(df, top=2).collect()] == [("a", 3), ("c", 2)]
    assert console.banner("x", 5).split("\n")[1] == "  x"


@pytest.mark.parametrize("ox,oy", [(100.0, 100.0), (-3000.0, 40.0), (1e6, -1e6)])
def test_nearest_of_far_points(spark, ox, oy):
    from meridian.operators import spatial

    a = [(i, i / 7, i * i % 5 / 5) for i in range(7)]
    b = [(j, ox + j * 3 % 10 / 10, oy + j * 7 % 10 / 10) for j in range(10)]
    found = spatial.nearest(spark.createDataFrame(a, "k long, x double, y double"), spark.createDataFrame(b, "j long, sx double, sy double"), "k", (F.col("x"), F.col("y")), (F.col("sx"), F.col("sy")), 3, ["j"], 0.3)
    want = {(k, n + 1, j) for k, x, y in a for n, (_, j) in enumerate(sorted((((sx - x) ** 2 + (sy - y) ** 2) ** 0.5, j) for j, sx, sy in b)[:3])}
    assert {(r.k, r["rank"], r.j) for r in found.collect()} == want


def test_interval_join_makes_no_pairs(spark, tmp_path):
    """Rows of one price count each other without being joined to each other."""
    prices = [10.0] * 40 + [10.25, 10.5, 10.75, 9.5, 9.75, None]
    spark.createDataFrame(list(enumerate(prices)), "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    df = queries.interval_join(spark, str(tmp_path))
    want = {(i, sum(q is not None and p <= q <= p + 0.5 for q in prices)) for i, p in enumerate(prices) if p is not None}
    assert {tuple(r) for r in df.collect()} == want
    assert "floor" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_pairs_are_measured_once(spark):
    pairs = spark.createDataFrame([(i, "select a from t", "SELECT a FROM t WHERE ST_X(g) > 1" if i % 2 else None) for i in range(20)], "i int, predicted string, gold string")
    scored = score.score_pairs(pairs)
    assert scored.count() == 20 and scored.select("gold", "string_similarity", "token", "geo", "spatial_exact").distinct().count() == 2
    above, _, below = scored._jdf.queryExecution().optimizedPlan().toString().partition("Join LeftOuter")
    assert "EvalPython" not in above and "EvalPython" in below
