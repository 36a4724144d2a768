"""Session settings and the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def build(app: str = "skein", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine's semantics rest on: UTC, ANSI, adaptive plans; names match by case.

    Partition numbers and memory are the cluster's own business, so none is set here.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.caseSensitive": "true", "spark.sql.adaptive.enabled": "true"}
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of the tables under their own names (all if none is named)."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
