"""How much correlation a set of breakpoints cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_block(rows: DataFrame, breakpoints: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the number of breakpoints below `column`: an as-of join by sorting both together, no range join."""
    marks = breakpoints.groupBy("chrom", "locus").agg(F.count(F.lit(1)).alias("_k")).select("chrom", F.col("locus").alias("_at"), F.col("_k"), F.lit(1).alias("_kind"))
    points = rows.select("chrom", F.col(column).alias("_at")).distinct().withColumn("_k", F.lit(0).cast("bigint")).withColumn("_kind", F.lit(0))
    # a breakpoint at the position itself does not count: points (kind 0) come before marks (kind 1)
    order = Window.partitionBy("chrom").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = points.unionByName(marks).withColumn(name, F.sum("_k").over(order)).filter("_kind = 0").select("chrom", F.col("_at").alias(column), name)
    return rows.join(numbered, ["chrom", column])


def crossing(pairs: DataFrame, breakpoints: DataFrame) -> DataFrame:
    """Pairs (lo, hi, r2) whose ends lie in different blocks."""
    both = with_block(with_block(pairs, breakpoints, "lo", "block_lo"), breakpoints, "hi", "block_hi")
    return both.filter("block_lo <> block_hi")


def metric(pairs: DataFrame, loci: DataFrame, breakpoints: DataFrame) -> DataFrame:
    """chrom, sum, n_nonzero, n_zero for chromosomes that have breakpoints.

    sum counts crossing pairs into every block; n_zero, (T^2 - sum of squared
    widths) / 2, counts positions up to the last breakpoint, and is 0 with one.
    """
    cut = crossing(pairs.select("chrom", "lo", "hi", "r2"), breakpoints).groupBy("chrom").agg(F.sum("r2").alias("s"), F.count(F.lit(1)).alias("n"))
    ends = breakpoints.groupBy("chrom").agg(F.max("locus").alias("last"), F.count_distinct("locus").alias("k"))
    inside = loci.select("chrom", "pos").distinct().join(ends, "chrom").filter("pos <= last").select("chrom", "pos")
    widths = with_block(inside, breakpoints, "pos", "block").groupBy("chrom", "block").agg(F.count(F.lit(1)).cast("double").alias("w"))
    area = widths.groupBy("chrom").agg(((F.sum("w") * F.sum("w") - F.sum(F.col("w") * F.col("w"))) / 2.0).alias("z"))
    out = ends.join(cut, "chrom", "left").join(area, "chrom", "left")
    return out.select("chrom", F.coalesce("s", F.lit(0.0)).alias("sum"), F.coalesce("n", F.lit(0)).alias("n_nonzero"), F.when(F.col("k") <= 1, 0.0).otherwise(F.coalesce("z", F.lit(0.0))).alias("n_zero"))


def metric_decimal(pairs: list[tuple[int, int, str]], loci: list[int], breakpoints: list[int], digits: int = 50) -> dict[str, object]:
    """The metric of one small chromosome in decimals of `digits` digits (Spark's end at 38)."""
    import bisect
    import decimal

    with decimal.localcontext() as context:
        context.prec = digits
        block = lambda p: bisect.bisect_left(breakpoints, p)
        cut = [decimal.Decimal(r) for lo, hi, r in pairs if block(lo) != block(hi)]
        counts: dict[int, int] = {}
        for p in (p for p in set(loci) if breakpoints and p <= breakpoints[-1]):
            counts[block(p)] = counts.get(block(p), 0) + 1
        total = decimal.Decimal(sum(counts.values()))
        zero = (total * total - sum((decimal.Decimal(w) ** 2 for w in counts.values()), decimal.Decimal(0))) / 2
        return {"sum": sum(cut, decimal.Decimal(0)) if breakpoints else decimal.Decimal(0), "n_nonzero": len(cut) if breakpoints else 0, "n_zero": zero if len(breakpoints) > 1 else decimal.Decimal(0)}


def unrefined(refined: DataFrame) -> DataFrame:
    """chrom, unrefined: breakpoints whose search gave no metric."""
    return refined.groupBy("chrom").agg(F.count_if(F.col("metric").isNull()).alias("unrefined"))
