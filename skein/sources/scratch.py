"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by local masters that name no shared folder (tests, single machine).
LOCAL_SCRATCH = "file:///tmp/checkpoints/skein"

_scratch: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only a local master may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or LOCAL_SCRATCH).rstrip("/")


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own scratch folder, which goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = f"{shared_dir(spark)}/skein-{app}-{uuid.uuid4().hex[:8]}"
        files, target = _file_system(spark, _scratch[app])
        files.mkdirs(target)
        files.deleteOnExit(target)
    return f"{_scratch[app]}/{name}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder once and read it again: later steps neither recompute it nor depend on one executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._skein_path = path
    return kept


def forget(kept: DataFrame) -> None:
    """Delete the table behind a frame of keep() that nothing will read any more."""
    files, target = _file_system(kept.sparkSession, kept._skein_path)
    files.delete(target, True)


def release_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; results that still read them must be written first."""
    if path := _scratch.pop(spark.sparkContext.applicationId, None):
        files, target = _file_system(spark, path)
        files.delete(target, True)
