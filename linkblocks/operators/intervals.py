"""Blocks and boundaries: building, merging, comparing. Frames: blocks (chrom, start, stop), boundaries (chrom, pos)."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocks_of(breakpoints: DataFrame, limits: DataFrame) -> DataFrame:
    """Contiguous blocks from snp_first over the loci to snp_last + 1; a chromosome without loci is one block."""
    edges = limits.select("chrom", F.col("snp_first").alias("pos")).unionByName(limits.select("chrom", (F.col("snp_last") + 1).alias("pos"))).unionByName(breakpoints.select("chrom", F.col("locus").alias("pos")))
    along = Window.partitionBy("chrom").orderBy("pos")
    return edges.withColumn("stop", F.lead("pos").over(along)).filter("stop is not null").select("chrom", F.col("pos").alias("start"), "stop")


def boundaries(blocks: DataFrame) -> DataFrame:
    return blocks.select("chrom", F.explode(F.array("start", "stop")).alias("pos")).distinct()


def internal_boundaries(blocks: DataFrame, shared: bool = True) -> DataFrame:
    """Positions that are both a start and a stop; or (shared=False) all stops but the last."""
    if shared:
        return blocks.select("chrom", F.col("start").alias("pos")).intersect(blocks.select("chrom", F.col("stop").alias("pos")))
    last = F.max("stop").over(Window.partitionBy("chrom"))
    return blocks.withColumn("_l", last).filter("stop < _l").select("chrom", F.col("stop").alias("pos"))


def drop_empty(blocks: DataFrame) -> DataFrame:
    return blocks.filter("start < stop")


def merge(blocks: DataFrame) -> DataFrame:
    """Touching and overlapping intervals as one: gaps and islands over a running maximum."""
    order = Window.partitionBy("chrom").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = blocks.withColumn("new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    grouped = opened.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("chrom", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def intersect(a: DataFrame, b: DataFrame, bin_size: int = 1_000_000) -> DataFrame:
    """Intersections of two sets of intervals that are disjoint in themselves: an equi-join on bins, each overlap taken in the bin where it begins."""
    binned = lambda d, s: d.select("chrom", F.col("start").alias(f"s{s}"), F.col("stop").alias(f"e{s}")).filter(f"s{s} < e{s}").withColumn("bin", F.explode(F.sequence(F.floor(F.col(f"s{s}") / bin_size), F.floor((F.col(f"e{s}") - 1) / bin_size))))
    both = binned(a, 1).join(binned(b, 2), ["chrom", "bin"])
    start, stop = F.greatest("s1", "s2"), F.least("e1", "e2")
    return both.filter((start < stop) & (F.floor(start / bin_size) == F.col("bin"))).select("chrom", start.alias("start"), stop.alias("stop"))


def without_overlaps(blocks: DataFrame, excluded: DataFrame) -> DataFrame:
    """Blocks that overlap none of the excluded intervals."""
    b, x = blocks.alias("b"), excluded.alias("x")
    return b.join(x, (F.col("b.chrom") == F.col("x.chrom")) & (F.col("b.start") < F.col("x.stop")) & (F.col("x.start") < F.col("b.stop")), "left_anti")


def covered(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("chrom").agg(F.sum(F.col("stop") - F.col("start")).alias("bp"))


def bp_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """chrom, jaccard: shared length over the length of both, four decimals; chromosomes of both sets only."""
    m, n = merge(a), merge(b)
    shared = covered(intersect(m, n)).withColumnRenamed("bp", "both")
    sums = covered(m).withColumnRenamed("bp", "x").join(covered(n).withColumnRenamed("bp", "y"), "chrom").join(shared, "chrom", "left").withColumn("both", F.coalesce("both", F.lit(0)))
    return sums.select("chrom", F.round(F.col("both") / F.nullif(F.col("x") + F.col("y") - F.col("both"), F.lit(0)), 4).alias("jaccard"))


def _at(values: Column, share: float, upper: bool) -> Column:
    n = F.size(values)
    index = F.floor(n * share).cast("int")
    return F.get(values, F.least(n - 1, index) if upper else F.greatest(F.lit(0), index))


def size_stats(blocks: DataFrame) -> DataFrame:
    """chrom, n, mean_kb, median_kb, p5_kb, p95_kb; percentiles are elements of the sorted sizes at int(n * share)."""
    sizes = blocks.groupBy("chrom").agg(F.sort_array(F.collect_list(F.col("stop") - F.col("start"))).alias("v"), F.avg(F.col("stop") - F.col("start")).alias("m"), F.percentile(F.col("stop") - F.col("start"), 0.5).alias("md"))
    kb = lambda c: F.round(c / 1000.0, 1)
    return sizes.select("chrom", F.size("v").cast("bigint").alias("n"), kb(F.col("m")).alias("mean_kb"), kb(F.col("md")).alias("median_kb"), kb(_at(F.col("v"), 0.05, False)).alias("p5_kb"), kb(_at(F.col("v"), 0.95, True)).alias("p95_kb"))


def nearest(query: DataFrame, reference: DataFrame) -> DataFrame:
    """chrom, pos, nearest, distance of each query position; ties go to the lower position; null without any reference.

    Both sides are sorted together once: the last reference before and the
    first after each position, no pairwise comparison.
    """
    q = query.select("chrom", "pos").distinct().withColumn("kind", F.lit(1))
    r = reference.select("chrom", "pos").distinct().withColumn("kind", F.lit(0))
    both = r.unionByName(q)
    mark = F.when(F.col("kind") == 0, F.col("pos"))
    back = Window.partitionBy("chrom").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("chrom").orderBy(F.desc("pos"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("below", F.last(mark, ignorenulls=True).over(back)).withColumn("above", F.last(mark, ignorenulls=True).over(ahead)).filter("kind = 1")
    lower = F.col("below").isNotNull() & (F.col("above").isNull() | (F.col("pos") - F.col("below") <= F.col("above") - F.col("pos")))
    at = F.when(lower, F.col("below")).otherwise(F.col("above"))
    return found.select("chrom", "pos", at.alias("nearest"), F.abs(at - F.col("pos")).alias("distance"))


def match_rate(query: DataFrame, reference: DataFrame, tolerance: int) -> DataFrame:
    near = nearest(query, reference).withColumn("hit", F.coalesce((F.col("distance") <= tolerance).cast("int"), F.lit(0)))
    return near.groupBy("chrom").agg(F.avg("hit").alias("rate"))


def offset_stats(query: DataFrame, reference: DataFrame) -> DataFrame:
    """chrom, median_kb, p90_kb of the distances to the nearest reference; without reference a distance is 10^9."""
    far = nearest(query, reference).withColumn("distance", F.coalesce("distance", F.lit(10**9)))
    v = far.groupBy("chrom").agg(F.sort_array(F.collect_list("distance")).alias("v"), F.percentile("distance", 0.5).alias("m"))
    return v.select("chrom", F.round(F.col("m") / 1000.0, 1).alias("median_kb"), F.round(_at(F.col("v"), 0.9, True) / 1000.0, 1).alias("p90_kb"))


def boundary_jaccard(a: DataFrame, b: DataFrame, tolerance: int) -> DataFrame:
    """chrom, jaccard of two boundary sets under a tolerance; null where one set is empty.

    One ordered pass over the union of both sets. Boundaries of one set wait, in
    order, for one of the other set; a boundary takes the first that waits
    within the tolerance, so each is matched once.
    """

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        waiting, side, hits, seen = deque(), None, 0, [0, 0]
        for pos, own in zip(group["pos"].tolist(), group["side"].tolist(), strict=True):
            seen[own] += 1
            if own != side:
                while waiting and waiting[0] < pos - tolerance:
                    waiting.popleft()
                if waiting:
                    waiting.popleft()
                    hits += 1
                    continue
                side = own
            waiting.append(pos)
        return pd.DataFrame({"chrom": group["chrom"].iloc[:1], "jaccard": [hits / (sum(seen) - hits) if all(seen) else None]})

    both = a.select("chrom", "pos", F.lit(0).alias("side")).unionByName(b.select("chrom", "pos", F.lit(1).alias("side"))).distinct()
    return both.groupBy("chrom").applyInPandas(lambda group: scan(group.sort_values(["pos", "side"])), "chrom string, jaccard double")


def merge_small(blocks: DataFrame, min_count: int) -> DataFrame:
    """Blocks (with n) of fewer than min_count positions join the block to their left, leading ones that to their right.

    A carried count of the blocks that are large enough numbers the merged
    blocks. What comes before the first of them is a block of its own if it has
    min_count positions together, and joins the first one if not.
    """
    along = Window.partitionBy("chrom").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    counted = blocks.withColumn("_k", F.count_if(F.col("n") >= min_count).over(along))
    leading = F.sum(F.when(F.col("_k") == 0, F.col("n"))).over(Window.partitionBy("chrom"))
    numbered = counted.withColumn("_k", F.when((F.col("_k") == 0) & (leading < min_count), 1).otherwise(F.col("_k")))
    return numbered.groupBy("chrom", "_k").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").cast("bigint").alias("n")).drop("_k")


def count_positions(blocks: DataFrame, positions: DataFrame, bin_size: int = 1_000_000) -> DataFrame:
    """blocks with n: positions in start + 1 .. stop. Equi-join on bins."""
    rows = blocks.filter("start < stop").withColumn("bin", F.explode(F.sequence(F.floor((F.col("start") + 1) / bin_size), F.floor(F.col("stop") / bin_size))))
    points = positions.select("chrom", "pos").withColumn("bin", F.floor(F.col("pos") / bin_size))
    hits = rows.join(points, ["chrom", "bin"]).filter("pos > start and pos <= stop").groupBy("chrom", "start", "stop").agg(F.count(F.lit(1)).alias("n"))
    return blocks.join(hits, ["chrom", "start", "stop"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
