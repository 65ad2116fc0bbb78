"""Readers and writers: corpora, predictions, reports, configurations and fingerprints of files."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridian.functions import text

CORPUS = T.StructType([T.StructField(n, T.IntegerType() if n == "train" else T.StringType()) for n in ("id", "question", "level", "sql_code", "train", "territorial_division", "geospatial_functions", "source")])
PREDICTIONS = T.StructType([
    T.StructField(n, T.StringType())
    for n in ("sql_validation_id", "nivel", "divisao", "funcao", "question", "sql_code_gold", "sql_code_base", "sql_code_finetuned", "raw_output_base", "raw_output_finetuned")
])
#: Where each version of the data set is, under its root.
VERSIONS = {"working": ("working", "validation"), "paper_released": ("paper_released/train.parquet", "paper_released/validation.parquet"), "paper_split": ("paper_split/train.parquet", "paper_split/validation.parquet")}


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    if missing := sorted({*names} - {*df.columns}):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def first_column(df: DataFrame, *names: str) -> str | None:
    return next((n for n in names if n in df.columns), None)


def present(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(n for n in names if n in df.columns))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything matches a path or glob in whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def required(spark: SparkSession, path: str, remedy: str = "") -> str:
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} not found. {remedy}".strip())
    return path


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By the ending: csv or tsv with a header, json (an array or lines), orc; anything else is Parquet."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending in ("csv", "tsv"):
        return spark.read.option("header", True).option("sep", "\t" if ending == "tsv" else ",").option("multiLine", True).option("escape", '"').csv(path)
    if ending == "json":
        return spark.read.option("multiLine", True).json(path)
    return spark.read.orc(path) if ending == "orc" else spark.read.parquet(path)


def corpus(spark: SparkSession, root: str, partition: str = "all") -> DataFrame:
    """A corpus in directories source=<p>; one partition reads its directory only."""
    df = spark.read.parquet(root)
    return df if partition == "all" else df.where(F.col("source") == partition)


def normalized_corpus(df: DataFrame) -> DataFrame:
    """Column `pergunta` becomes question, tiers get their right spelling."""
    if "pergunta" in df.columns and "question" not in df.columns:
        df = df.withColumnRenamed("pergunta", "question")
    return df.withColumn("level", text.fixed_level(F.col("level"))) if "level" in df.columns else df


def dataset(spark: SparkSession, root: str, version: str = "working", part: str = "train", source: str = "all", limit: int = 0) -> DataFrame:
    """The train pool or hold-out of a version of the data set. `limit` takes that many rows by id, for smoke runs."""
    if version not in VERSIONS:
        raise ValueError(f"unknown version {version!r}: {', '.join(VERSIONS)}")
    path = f"{root}/{VERSIONS[version][part != 'train']}"
    if version == "working":
        path = f"{root}/working"
    df = normalized_corpus(spark.read.parquet(required(spark, path, "Build the split first." if version == "paper_split" else "")))
    if source != "all" and "source" in df.columns:
        df = df.where(F.col("source") == source)
    if version == "working":
        df = require_columns(df, "train").where(F.col("train").cast("int") == (1 if part == "train" else 0))
    return df.orderBy("id").limit(limit) if limit > 0 else df


def discover_predictions(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of predictions_v<N>.json that match a glob, each once, by number, then name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    return ordered_versions([s.getPath().toString() for s in found])


def ordered_versions(paths: list[str]) -> list[str]:
    import re

    def number(path: str) -> tuple:
        m = re.search(r"_v(\d+)\.json$", path)
        return (0, int(m[1]), path) if m else (1, 0, path)

    return sorted({resolved(p): p for p in reversed(paths)}.values(), key=number)


def resolved(path: str) -> str:
    """One spelling of a path: a local one absolute and without links, a store's without `.`, `..` and doubled slashes."""
    scheme, mark, rest = path.partition("://")
    if not mark:
        return os.path.realpath(path.removeprefix("file:"))
    if scheme == "file":
        return os.path.realpath(rest)
    host, _, inner = rest.partition("/")
    return f"{scheme}://{host}{os.path.normpath('/' + inner.lstrip('/'))}"


def read_predictions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Prediction records of JSON arrays, with the experiment's label by file name."""
    df = spark.read.schema(PREDICTIONS).option("multiLine", True).json(paths)
    return df.withColumn("experiment", text.version_label(F.col("_metadata.file_path")))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_failures(df: DataFrame, path: str) -> None:
    """The audit's rows that are not ok, as CSV with a header."""
    names = ["row_index", "id", "level", "status", "elapsed_s", "error", "sql"]
    df.where("status <> 'ok'").select(*names).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(value: object, path: str) -> None:
    """A small report on the driver's side."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2, default=str), encoding="utf-8")


def consolidated(experiments: dict[str, DataFrame], db_used: bool = True, compare_mode: str = "auto_robust") -> DataFrame:
    """Summaries of several experiments in one table, with the time of the report, whether queries were run, and how results were compared."""
    out = None
    for name, df in experiments.items():
        own = df.withColumn("experiment", F.lit(name))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no experiment")
    return out.withColumns({"generated_at": F.current_timestamp(), "db_used": F.lit(db_used), "compare_mode": F.lit(compare_mode)})


def write_split(train: DataFrame, validation: DataFrame, manifest: dict, folder: str) -> None:
    """Both parts of a split as Parquet, train/ and validation/, and split_manifest.json with the digest of each part's files.

    Everything goes through Spark's file systems, so the folder may be in any store."""
    spark = train.sparkSession
    digests = {}
    for name, part in (("train", train), ("validation", validation)):
        part.write.mode("overwrite").parquet(f"{folder}/{name}")
        files = md5_of_files(spark, f"{folder}/{name}/*.parquet").orderBy("md5").select("md5").collect()  # one for each file written
        digests[f"{name}_md5"] = hashlib.md5("".join(r[0] for r in files).encode()).hexdigest()
    whole = json.dumps({**manifest, **digests}, ensure_ascii=False, indent=2)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/split_manifest.json")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(whole.encode("utf-8")))
    out.close()


def md5_of_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, md5) of whole files; each is read by one task."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", F.md5("content").alias("md5"))


def read_config(path: str) -> dict:
    """A flat YAML file: scalars, lists in brackets or dashes, quoted and block text. By PyYAML where it is installed."""
    raw = Path(path).read_text(encoding="utf-8")
    try:
        import yaml
    except ImportError:
        return _flat_yaml(raw)
    return yaml.safe_load(raw) or {}


def _scalar(raw: str) -> object:
    raw = raw.strip()
    if raw[:1] in "\"'" and raw[-1:] == raw[:1] and len(raw) > 1:
        return raw[1:-1].replace("\\n", "\n") if raw[0] == '"' else raw[1:-1].replace("''", "'")
    raw = raw.split(" #")[0].strip()
    if raw.startswith("[") and raw.endswith("]"):
        return [_scalar(x) for x in raw[1:-1].split(",") if x.strip()]
    if raw.lower() in ("true", "false"):
        return raw.lower() == "true"
    if raw.lower() in ("", "null", "~"):
        return None
    for kind in (int, float):
        try:
            return kind(raw)
        except ValueError:
            pass
    return raw


def _flat_yaml(raw: str) -> dict:
    out: dict = {}
    key = None
    for line in raw.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line.lstrip().startswith("- ") and key is not None:
            out[key] = [*(out[key] or []), _scalar(line.strip()[2:])]
        elif ":" in line and not line[0].isspace():
            key, _, value = line.partition(":")
            key = key.strip()
            out[key] = _scalar(value)
    return out


def save_run_id(folder: str, run_id: str) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    (Path(folder) / "run_id.txt").write_text(run_id.strip() + "\n", encoding="utf-8")


def load_run_id(folder: str) -> str | None:
    path = Path(folder) / "run_id.txt"
    return path.read_text(encoding="utf-8").strip() or None if path.exists() else None


def masked_uri(uri: str) -> str:
    """A connection string without its password."""
    import re

    return re.sub(r"(://[^:/@\s]+:)[^@\s]*@", r"\1****@", uri)


def register_tables(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Parquet tables of a folder as temporary views, for queries in SQL text."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table of a database, read in ranges of a numeric column; the driver's jar has to be on the class path."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()
