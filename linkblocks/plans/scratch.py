"""Stage outputs as Parquet in the folder that all executors share; reading them back cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_paths: dict[tuple[str, str, str], tuple[str, object]] = {}


def folder(spark: SparkSession) -> str:
    """Under spark.checkpoint.dir; a local folder only where the cluster names none and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="linkblocks-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/linkblocks-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The output of a named stage over `source`: made once an application, read from Parquet after that."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _paths:
        made = make()
        path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        made.write.option("compression", "zstd").parquet(path)
        _paths[key] = (path, made.schema)
    path, schema = _paths[key]
    return spark.read.schema(schema).parquet(path)


def forget() -> None:
    """Make every stage anew when it is next asked for."""
    _paths.clear()
