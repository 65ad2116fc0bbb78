"""Tables written between the steps of a plan, so that a step is computed once and a lost executor does not undo it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PATH = "_meridian_path"


def folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names. Only a session on one machine gets a folder of its own, deleted at exit."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="meridian-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def materialized(df: DataFrame) -> DataFrame:
    """Writes the rows as Parquet into the checkpoint folder, and reads them: this cuts the lineage.

    A written table forgets the plan that made it, and with it column identities that later self-joins may stumble on."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    return out


def discarded(*tables: DataFrame) -> None:
    """Deletes tables that materialized() gave and that nothing reads any more: what was made of them is written itself."""
    for df in tables:
        if path := getattr(df, _PATH, None):
            jvm = df.sparkSession.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
