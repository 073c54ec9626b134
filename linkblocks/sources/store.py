"""The covariance store: Parquet by chromosome and partition, sorted by (lo, hi), so ranges of lo prune row groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import covariance

COMPACT = T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("shrink_ld", T.DoubleType()), T.StructField("chrom", T.StringType()), T.StructField("p_index", T.IntegerType())])
FULL = ("i_gpos", "j_gpos", "naive_ld", "i_id", "j_id")


class CovarianceStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def write(self, cov: DataFrame, compression: str = "zstd", overwrite_all: bool = False) -> None:
        """Write partitions; those that `cov` has none of stay as they are."""
        rows = cov.repartition("chrom", "p_index").sortWithinPartitions("chrom", "p_index", "lo", "hi")
        options = {"compression": compression} | ({} if overwrite_all else {"partitionOverwriteMode": "dynamic"})
        rows.write.mode("overwrite").partitionBy("chrom", "p_index").options(**options).parquet(self.root)

    def read(self, full: bool = False) -> DataFrame:
        found = self.spark.read.parquet(self.root)
        self.validate(found, full)
        extra = [c for c in FULL if c in found.columns] if full else []
        return found.select(F.col("chrom").cast("string"), F.col("p_index").cast("int"), "lo", "hi", "shrink_ld", *extra)

    @staticmethod
    def validate(found: DataFrame, full: bool = False) -> None:
        missing = [c for c in ("chrom", "p_index", "lo", "hi", "shrink_ld", *(FULL if full else ())) if c not in found.columns]
        if missing:
            raise ValueError(f"not a covariance store: no {', '.join(missing)}")

    def diagonal(self) -> DataFrame:
        return self.read().filter("lo = hi")

    def loci(self) -> DataFrame:
        return self.read().select("chrom", "p_index", F.col("lo").alias("pos")).distinct()

    def lo_range(self, chrom: str, low: int, high: int) -> DataFrame:
        return self.read().filter((F.col("chrom") == chrom) & F.col("lo").between(low, high))

    def owned(self, partitions: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
        return covariance.owned(self.read(), partitions, first, last)

    def row_counts(self) -> DataFrame:
        return self.read().groupBy("chrom", "p_index").agg(F.count(F.lit(1)).alias("rows"))

    def lo_index(self) -> DataFrame:
        """chrom, p_index, lo, n, offset: where each lo begins in its partition."""
        from pyspark.sql import Window

        counted = self.read().groupBy("chrom", "p_index", "lo").agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("chrom", "p_index").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
        return counted.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))

    def present(self) -> set[tuple[str, int]]:
        """(chrom, p_index) that are written, for a resumed run."""
        try:
            return {(r[0], r[1]) for r in self.read().select("chrom", "p_index").distinct().collect()}
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return set()
            raise

    def delete(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def unsorted_or_repeated(cov: DataFrame) -> DataFrame:
    """Pairs that occur twice in a partition, or with lo > hi; a well-made store has none."""
    return cov.groupBy("chrom", "p_index", "lo", "hi").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or lo > hi")
