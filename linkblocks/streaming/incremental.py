"""Covariance partitions as a stream: each micro-batch of finished partitions is added to the store once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import COMPACT, CovarianceStore


def follow(spark: SparkSession, incoming: str, store: str, checkpoint: str) -> StreamingQuery:
    """Read new Parquet files (lo, hi, shrink_ld, chrom, p_index) from `incoming` and write their partitions to the store.

    A partition that arrives again replaces the stored one, so a batch that is
    run twice after a failure changes nothing.
    """
    rows = spark.readStream.schema(COMPACT).parquet(incoming)

    def add(batch: DataFrame, _: int) -> None:
        once = batch.groupBy("chrom", "p_index", "lo", "hi").agg(F.first("shrink_ld").alias("shrink_ld"))
        CovarianceStore(batch.sparkSession, store).write(once)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
