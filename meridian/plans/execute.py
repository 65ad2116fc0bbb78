"""Runs queries under a gate: reads only, with a time limit, errors as text. And compares what two queries return."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from meridian.operators import compare
from meridian.plans.dialect import to_spark
from meridian.plans.sql_compare import text as sql_text
from meridian.plans.sql_tree import SqlError, parse

AUDIT = "row_index int, id string, level string, status string, elapsed_s double, error string, sql string"


class TimedOut(Exception):
    """A statement took longer than its limit."""


def prepared(spark: SparkSession, sql: str | None) -> tuple[DataFrame | None, str | None]:
    """An analysed query, or the first line of why there is none. Nothing runs: what is not a query never reaches Spark."""
    if sql is None or not sql.strip():
        return None, "empty sql"
    try:
        return spark.sql(to_spark(sql)), None
    except (SqlError, PySparkException) as e:
        return None, str(e).strip().split("\n")[0]


def executable(spark: SparkSession, sql: str | None) -> tuple[bool, str | None]:
    df, error = prepared(spark, sql)
    return df is not None, error


def limited(spark: SparkSession, action, seconds: float):
    """The result of an action; TimedOut if it takes longer, its jobs cancelled. Other jobs of the session go on."""
    tag, late = f"limit-{uuid.uuid4().hex}", threading.Event()

    def cancel() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, cancel)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        return action()
    except Exception as e:
        if late.is_set():
            raise TimedOut(f"canceling statement due to statement timeout ({seconds:g} s)") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


@dataclass
class Execution:
    match: bool
    mode: str
    predicted_error: str | None
    gold_error: str | None


def _placed(df: DataFrame, sql: str) -> DataFrame:
    """A query's rows with their place, for modes in which order counts.

    A sorted query's order lives in its plan; its rows are numbered partition by partition, as they come."""
    rdd = df.rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    schema = df.schema.add(compare.INDEX, "long")
    return df.sparkSession.createDataFrame(rdd, schema)


def execution_accuracy(spark: SparkSession, predicted: str | None, gold: str | None, mode: str = "auto_robust", seconds: float = 15.0) -> Execution:
    """Whether two queries return the same rows, in Spark; no result set comes to the driver.

    mode: set, multiset, list, ordered_robust, auto_text or auto_robust."""
    mode = compare.mode_by_text(gold, mode)
    mode, keys = compare.mode_by_keys(gold, mode)
    a, a_error = prepared(spark, predicted)
    b, b_error = prepared(spark, gold)
    if a is None or b is None:
        return Execution(False, mode, a_error, b_error)
    ordered = mode == "list" or mode == "ordered_robust" and keys
    try:
        return Execution(bool(limited(spark, lambda: compare.same(*((_placed(a, predicted), _placed(b, gold)) if ordered else (a, b)), mode, keys), seconds)), mode, None, None)
    except TimedOut as e:
        return Execution(False, mode, str(e), None)
    except Exception as e:  # a row that fails at run time
        return Execution(False, mode, str(e).strip().split("\n")[0], None)


def executions(spark: SparkSession, pairs: DataFrame, mode: str = "auto_robust", seconds: float = 15.0) -> DataFrame:
    """(predicted, gold, execution_match, executable, gold_executable, execution_error) of each distinct pair.

    Queries are started from the driver one after another: the pairs are as many as a benchmark has, and come in one by one."""
    out = []
    for row in pairs.select("predicted", "gold").distinct().toLocalIterator():
        e = execution_accuracy(spark, row["predicted"], row["gold"], mode, seconds)
        out.append((row["predicted"], row["gold"], e.match, executable(spark, row["predicted"])[0], executable(spark, row["gold"])[0], e.predicted_error or e.gold_error))
    return spark.createDataFrame(out, "predicted string, gold string, execution_match boolean, executable boolean, gold_executable boolean, execution_error string")


def audit(spark: SparkSession, corpus: DataFrame, run: bool = False, seconds: float = 30.0) -> DataFrame:
    """Each gold query's status: ok, timeout, error or empty; only analysed, or run too. Rows by id."""
    out = []
    for i, row in enumerate(corpus.select("id", "level", "sql_code").orderBy("id").toLocalIterator()):
        began, sql = time.monotonic(), row["sql_code"]
        df, error = prepared(spark, sql)
        status = "empty" if not (sql or "").strip() else "error" if df is None else "ok"
        if df is not None and run:
            try:
                limited(spark, lambda: df.write.format("noop").mode("overwrite").save(), seconds)  # noqa: B023
            except TimedOut as e:
                status, error = "timeout", str(e)
            except Exception as e:
                status, error = "error", str(e).strip().split("\n")[0]
        out.append((i, row["id"], row["level"], status, round(time.monotonic() - began, 3), error, sql))
    return spark.createDataFrame(out, AUDIT)


def status_counts(audited: DataFrame) -> DataFrame:
    """How many queries of an audit have each status."""
    return audited.groupBy("status").count()


def tidy(sql: str) -> str:
    """A query's text as the parser writes it."""
    return sql_text(parse(sql))
