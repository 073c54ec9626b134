"""The pair matrix as one number a position: sums of r2 along its anti-diagonals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from .covariance import correlations


def relevant(partitions: DataFrame, first: int, last: int) -> DataFrame:
    """From the first partition that holds `first` to the last one that holds `last`; none if either is in no partition."""
    spans = partitions.groupBy("chrom").agg(F.min(F.when(F.lit(first).between(F.col("start"), F.col("end")), F.col("p_index"))).alias("a"), F.max(F.when(F.lit(last).between(F.col("start"), F.col("end")), F.col("p_index"))).alias("b"))
    return partitions.join(spans, "chrom").filter("p_index between a and b").drop("a", "b")


def default_range(partitions: DataFrame) -> DataFrame:
    """chrom, snp_first, snp_last: from the first partition's start to the last one's end."""
    return partitions.groupBy("chrom").agg(F.min_by("start", "p_index").alias("snp_first"), F.max_by("end", "p_index").alias("snp_last"))


def seams(partitions: DataFrame, loci: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Which centers each partition credits: after the seam with the one before, up to the seam with the next.

    The last partition's upper edge is the largest position it holds, which the
    vector leaves out; partitions wholly before `first` are skipped.
    """
    along = Window.partitionBy("chrom").orderBy("p_index")
    parts = partitions.withColumn("next_start", F.lead("start").over(along))
    if first is not None:
        parts = parts.filter(F.col("next_start").isNull() | (F.col("next_start") > first))
    limits = default_range(partitions)
    limits = limits.select("chrom", (F.lit(first) if first is not None else F.col("snp_first")).alias("snp_first"), (F.lit(last) if last is not None else F.col("snp_last")).alias("snp_last"))
    parts = parts.join(limits, "chrom").withColumn("edge", F.coalesce(scalar.seam(F.col("end"), F.col("next_start")), F.col("snp_last")))
    parts = parts.withColumn("below", F.lag("edge").over(along))
    top = loci.groupBy("chrom").agg(F.max("pos").alias("top"))
    return parts.join(top, "chrom").select("chrom", "p_index", "start", "end", "snp_first", "snp_last", "below", F.when(F.col("next_start").isNull(), F.least("edge", F.col("top") - 1)).otherwise(F.col("edge")).alias("edge"))


def to_vector(cov: DataFrame, partitions: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """chrom, pos, value: for each position the r2 of the pairs centered on it.

    A pair of ranks (a, b) counts at rank (a + b) // 2; if b - a is odd only
    where a > 0. Diagonals count 1. Each partition uses its own rows, ranks and
    diagonals; sums of 0 and the last position are left out.
    """
    inside = cov.join(partitions, ["chrom", "p_index"]).filter((F.col("lo") >= F.col("start")) & (F.col("hi") <= F.col("end"))).select(*cov.columns)
    if first is not None:
        inside = inside.filter(F.col("lo") >= first)
    if last is not None:
        inside = inside.filter(F.col("hi") <= last)
    loci = inside.select("chrom", "p_index", F.col("lo").alias("pos")).distinct()
    ranked = loci.withColumn("rank", F.row_number().over(Window.partitionBy("chrom", "p_index").orderBy("pos")) - 1)
    own = inside.filter("lo = hi and shrink_ld > 0").select("chrom", "p_index", F.col("lo").alias("pos"), F.col("shrink_ld").alias("d"))
    known = ranked.join(own, ["chrom", "p_index", "pos"])
    low, high = (known.select("chrom", "p_index", F.col("pos").alias(c), F.col("d").alias(f"d_{c}"), F.col("rank").alias(f"r_{c}")) for c in ("lo", "hi"))
    pairs = inside.join(low, ["chrom", "p_index", "lo"]).join(high, ["chrom", "p_index", "hi"])
    pairs = pairs.filter("(r_hi - r_lo) % 2 = 0 or r_lo > 0")
    sums = pairs.groupBy("chrom", "p_index", F.floor((F.col("r_lo") + F.col("r_hi")) / 2).cast("int").alias("rank")).agg(F.sum(scalar.r_squared(F.col("shrink_ld"), F.col("d_lo"), F.col("d_hi"))).alias("value"))
    placed = sums.join(ranked, ["chrom", "p_index", "rank"]).join(seams(partitions, loci, first, last), ["chrom", "p_index"])
    mine = (F.col("pos") <= F.col("edge")) & F.when(F.col("below").isNull(), F.col("pos") >= F.col("snp_first")).otherwise(F.col("pos") > F.col("below")) & (F.col("pos") <= F.col("snp_last"))
    return placed.filter(mine).groupBy("chrom", "pos").agg(F.sum("value").alias("value")).filter("value > 0")


def whole_vector(cov: DataFrame) -> DataFrame:
    """The vector of a matrix that is one partition."""
    parts = cov.groupBy("chrom").agg(F.min("lo").alias("start"), F.max("hi").alias("end")).withColumn("p_index", F.lit(0))
    return to_vector(cov.drop("p_index").withColumn("p_index", F.lit(0)), parts)


def vector_summary(vector: DataFrame) -> DataFrame:
    return vector.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("mean_value"), F.stddev_pop("value").alias("sd_value"))


def row_sums(pairs: DataFrame) -> DataFrame:
    """chrom, pos, vert (sum of r2 by lower end), horiz (by upper end)."""
    both = pairs.select("chrom", F.explode(F.array(F.struct(F.col("lo").alias("pos"), F.col("r2").alias("v"), F.lit(0.0).alias("h")), F.struct(F.col("hi").alias("pos"), F.lit(0.0).alias("v"), F.col("r2").alias("h")))).alias("s")).select("chrom", "s.*")
    return both.groupBy("chrom", "pos").agg(F.sum("v").alias("vert"), F.sum("h").alias("horiz"))


def diagonal_r2(cov: DataFrame) -> DataFrame:
    from .covariance import diagonals

    return correlations(cov, diagonals(cov), keep_diagonal=True)
