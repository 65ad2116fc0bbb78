"""A session with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """The active session or a new one; `settings` come with underscores for dots.

    `checkpoint_dir` names the folder for tables between steps; on a cluster all executors must share it."""
    builder = SparkSession.builder.appName("meridian")
    if master:
        builder = builder.master(master)
    if folder := settings.pop("checkpoint_dir", None):
        builder = builder.config("spark.checkpoint.dir", folder)
    for key, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
