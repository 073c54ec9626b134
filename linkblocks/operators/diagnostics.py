"""Summaries of the covariance store and of correlation around boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import memory_mb
from .covariance import diagonals, owned


def covariance_summary(cov: DataFrame, partitions: DataFrame) -> DataFrame:
    """chrom, partition, rows, diag_rows, offdiag_rows, owned_offdiag_rows, unique_loci and four memory columns; a TOTAL row for each chromosome, whose loci are distinct over all."""
    counted = cov.groupBy("chrom", "p_index").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("lo") == F.col("hi")).alias("diag_rows"), F.count_if(F.col("lo") < F.col("hi")).alias("offdiag_rows"))
    mine = owned(cov, partitions)
    pairs = mine.groupBy("chrom", "p_index").agg(F.count_if(F.col("lo") < F.col("hi")).alias("owned_offdiag_rows"))
    # each position once a partition before the global distinct
    loci = mine.select("chrom", "p_index", F.explode(F.array("lo", "hi")).alias("pos")).distinct()
    unique = loci.groupBy("chrom", "p_index").agg(F.count(F.lit(1)).alias("unique_loci"))
    every = loci.select("chrom", "pos").distinct().groupBy("chrom").agg(F.count(F.lit(1)).alias("unique_loci"))
    rows = partitions.select("chrom", "p_index").join(counted, ["chrom", "p_index"], "left").join(pairs, ["chrom", "p_index"], "left").join(unique, ["chrom", "p_index"], "left").na.fill(0)
    sums = ["rows", "diag_rows", "offdiag_rows", "owned_offdiag_rows"]
    total = rows.groupBy("chrom").agg(*[F.sum(c).alias(c) for c in sums]).join(every, "chrom", "left").na.fill(0).withColumn("partition", F.lit("TOTAL"))
    each = rows.withColumn("partition", F.col("p_index").cast("string")).drop("p_index")
    both = each.unionByName(total.select(*each.columns))
    wide = memory_mb(F.col("unique_loci"), F.col("owned_offdiag_rows"), 8)
    narrow = memory_mb(F.col("unique_loci"), F.col("owned_offdiag_rows"), 4)
    return both.select("chrom", "partition", *sums, "unique_loci", F.round(wide, 3).alias("final_int64_mb"), F.round(narrow, 3).alias("final_int32_mb"), F.round(wide * 3, 3).alias("peak_low_mb"), F.round(wide * 6, 3).alias("peak_high_mb"))


def separation(cov: DataFrame, partitions: DataFrame, boundaries: DataFrame, window: int = 500_000) -> DataFrame:
    """chrom, boundary, category, lo, hi, r2 of the owned pairs within the window of each boundary (chrom, pos): left of it, across, right.

    The boundary belongs to the right. A pair counts once a boundary; r2 asks
    for a positive product of both diagonals. Pairs meet boundaries by bins of
    one window's width.
    """
    first = Window.partitionBy("chrom", "lo", "hi").orderBy("p_index")
    once = cov.filter("lo < hi").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    d = diagonals(cov)
    low, high = (d.select("chrom", F.col("pos").alias(c), F.col("value").alias(f"d_{c}")) for c in ("lo", "hi"))
    pairs = once.join(low, ["chrom", "lo"]).join(high, ["chrom", "hi"]).filter("d_lo * d_hi > 0").select("chrom", "lo", "hi", (F.col("shrink_ld") * F.col("shrink_ld") / (F.col("d_lo") * F.col("d_hi"))).alias("r2"))
    size = max(1, window)
    marks = boundaries.select("chrom", F.col("pos").alias("boundary")).distinct().withColumn("bin", F.explode(F.sequence(F.floor((F.col("boundary") - window) / size), F.floor((F.col("boundary") + window) / size))))
    near = pairs.withColumn("bin", F.floor(F.col("lo") / size)).join(marks, ["chrom", "bin"]).filter((F.col("lo") >= F.col("boundary") - window) & (F.col("hi") <= F.col("boundary") + window))
    category = F.when(F.col("hi") < F.col("boundary"), "left").when(F.col("lo") >= F.col("boundary"), "right").otherwise("across")
    return near.select("chrom", "boundary", category.alias("category"), "lo", "hi", "r2")


def sample(samples: DataFrame, limit: int | None = 200_000, seed: int = 1) -> DataFrame:
    """At most `limit` rows of each chromosome and category, each as likely as any other; all of them where there are fewer, or without a limit."""
    if limit is None:
        return samples
    order = Window.partitionBy("chrom", "category").orderBy(F.xxhash64(F.lit(seed), "boundary", "lo", "hi"), "boundary", "lo", "hi")
    return samples.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n")


def separation_summary(samples: DataFrame) -> DataFrame:
    """chrom, boundary, category, n, mean and linear quantiles of r2."""
    q = lambda p: F.percentile("r2", p)
    return samples.groupBy("chrom", "boundary", "category").agg(F.count(F.lit(1)).alias("n"), F.avg("r2").alias("mean_r2"), q(0.5).alias("median_r2"), q(0.25).alias("q1_r2"), q(0.75).alias("q3_r2"), q(0.9).alias("p90_r2"))


def genomewide_separation(summary: DataFrame) -> DataFrame:
    """chrom, left/across/right medians of medians, within (mean of left and right), across_over_within."""
    wide = summary.filter("n > 0").groupBy("chrom").pivot("category", ["left", "across", "right"]).agg(F.percentile("median_r2", 0.5))
    within = (F.col("left") + F.col("right")) / 2.0
    return wide.select("chrom", F.col("left").alias("left_median_r2"), F.col("across").alias("across_median_r2"), F.col("right").alias("right_median_r2"), within.alias("within_median_avg_r2"), (F.col("across") / F.when(within > 0, within)).alias("across_over_within"))
