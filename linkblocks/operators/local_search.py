"""Local search: each breakpoint moves where its own window cuts the least correlation.

All breakpoints of all chromosomes are searched in one plan; a breakpoint is
moved on its own, from the raw set's sum and number of empty cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar


def windows(breakpoints: DataFrame, limits: DataFrame, partitions: DataFrame | None = None) -> DataFrame:
    """chrom, idx, locus, first, stop, bottom, top, listed, is_first of each breakpoint (chrom, idx, locus).

    The search goes from the midpoint with the breakpoint before to the one
    with the next; the ends of the chromosome's range (chrom, snp_first,
    snp_last, range_start, range_end) stand in for missing neighbours.
    Positions up to `listed` count as rows of the window: up to its stop. With
    partitions (chrom, p_index, start, end) a missing neighbour is the start of
    the first partition that holds `first`, or the end of the last one that
    holds `stop`, and `listed` reaches at least the start of the last partition
    that holds the top; what no partition holds is null.
    """
    along = Window.partitionBy("chrom").orderBy("idx")
    rows = breakpoints.withColumn("before", F.lag("locus").over(along)).withColumn("after", F.lead("locus").over(along)).join(limits, "chrom")
    spans = rows.select(
        "chrom",
        "idx",
        "locus",
        F.when(F.col("before").isNull(), F.col("snp_first")).otherwise(scalar.midpoint(F.col("before"), F.col("locus"))).alias("first"),
        F.when(F.col("after").isNull(), F.col("snp_last")).otherwise(scalar.midpoint(F.col("locus"), F.col("after"))).alias("stop"),
        F.coalesce("before", "range_start").alias("bottom"),
        F.coalesce("after", "range_end").alias("top"),
        F.col("before").isNull().alias("is_first"),
        F.col("after").isNull().alias("is_last"),
    )
    if partitions is None:
        return spans.withColumn("listed", F.col("stop")).drop("is_last")
    # a chromosome's partitions are few: they travel as one array
    tables = partitions.groupBy("chrom").agg(F.sort_array(F.collect_list(F.struct("p_index", "start", "end"))).alias("parts"))
    holding = lambda column: F.filter("parts", lambda p: F.col(column).between(p["start"], p["end"]))
    held = spans.join(tables, "chrom", "left")
    held = held.withColumn("bottom", F.when(F.col("is_first"), F.get(holding("first"), F.lit(0))["start"]).otherwise(F.col("bottom")))
    held = held.withColumn("top", F.when(F.col("is_last"), F.try_element_at(holding("stop"), F.lit(-1))["end"]).otherwise(F.col("top")))
    last = F.try_element_at(holding("top"), F.lit(-1))["start"]
    known = F.exists("parts", lambda p: F.col("bottom").between(p["start"], p["end"])) & last.isNotNull()
    return held.withColumn("listed", F.when(known, F.greatest("stop", last))).drop("is_last", "parts")


def valid(spans: DataFrame) -> DataFrame:
    """Windows that can be searched: first < locus < stop, neighbours not crossed, their range in partitions."""
    return spans.filter("listed is not null and first < stop and locus > first and locus < stop and bottom <= locus and locus <= top")


def _last_window(positions: DataFrame, spans: DataFrame, column: str, edge: str, included) -> DataFrame:
    """chrom, `column`, idx: the last window whose `edge` lies below each position (or at it, where `included`). Both are sorted together once."""
    marks = spans.select("chrom", F.col(edge).alias("_at"), F.when(included, 0).otherwise(2).alias("_kind"), F.col("idx").alias("_i"))
    points = positions.select("chrom", F.col(column).alias("_at")).distinct().withColumn("_kind", F.lit(1)).withColumn("_i", F.lit(None).cast(spans.schema["idx"].dataType))
    order = Window.partitionBy("chrom").orderBy("_at", "_kind", "_i").rowsBetween(Window.unboundedPreceding, 0)
    found = marks.unionByName(points).withColumn("idx", F.last("_i", ignorenulls=True).over(order))
    return found.filter("_kind = 1 and idx is not null").select("chrom", F.col("_at").alias(column), "idx")


def curves(spans: DataFrame, pairs: DataFrame, loci: DataFrame, totals: DataFrame) -> DataFrame:
    """chrom, idx, pos, side, sum, n, metric, distance: the metric with the breakpoint at each position of its window.

    pairs (chrom, lo, hi, r2, diagonal rows may be there: they cancel) belong
    to the window that holds lo, with hi up to the window's top. loci: chrom,
    pos. totals: chrom, sum, n_zero of the raw set.
    """
    # windows tile the range: each lo has one, found by sorting, and pairs then meet windows by equality
    of = _last_window(pairs, spans, "lo", "first", F.col("is_first"))
    limits = spans.select("chrom", "idx", "stop", "top")
    held = pairs.join(of, ["chrom", "lo"]).join(limits, ["chrom", "idx"]).filter("lo <= stop and hi <= top")
    ends = held.select("chrom", "idx", F.explode(F.array(F.struct(F.col("lo").alias("pos"), F.col("r2").alias("d")), F.struct(F.col("hi").alias("pos"), (-F.col("r2")).alias("d")))).alias("e")).select("chrom", "idx", "e.*")
    change = ends.groupBy("chrom", "idx", "pos").agg(F.sum("d").alias("d"))  # vert - horiz
    # a window reaches from the breakpoint before it to the one after it, so a position is in three of them at most
    near = _last_window(loci, spans, "pos", "bottom", F.lit(True)).select("chrom", "pos", F.explode(F.array(*[F.col("idx") - back for back in range(3)])).alias("idx"))
    listed = near.join(spans, ["chrom", "idx"]).filter("pos >= bottom and pos <= listed")
    ranked = listed.withColumn("r", F.row_number().over(Window.partitionBy("chrom", "idx").orderBy("pos")) - 1)
    each = Window.partitionBy("chrom", "idx")
    ranked = ranked.withColumn("top_rank", F.max("r").over(each)).withColumn("at", F.max(F.when(F.col("pos") <= F.col("locus"), F.struct("r", "pos"))).over(each))
    ranked = ranked.filter("at is not null").join(change, ["chrom", "idx", "pos"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    grow = (F.col("top_rank") - F.col("r")) - (F.col("r") - 1)
    right = ranked.filter("r > at.r and pos <= stop").withColumn("side", F.lit("right"))
    left = ranked.filter((F.col("r") < F.col("at.r")) & (F.col("pos") > F.col("first"))).withColumn("side", F.lit("left"))
    ahead = Window.partitionBy("chrom", "idx").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("chrom", "idx").orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, 0)
    right = right.withColumn("ds", F.sum("d").over(ahead)).withColumn("dn", F.sum(grow).over(ahead))
    left = left.withColumn("ds", F.sum(-F.col("d")).over(back)).withColumn("dn", F.sum(-grow).over(back))
    both = right.unionByName(left).join(totals.select("chrom", F.col("sum").alias("s0"), F.col("n_zero").alias("n0")), "chrom")
    out = both.withColumn("sum", F.col("s0") + F.col("ds")).withColumn("n", F.col("n0") + F.col("dn"))
    return out.select("chrom", "idx", "locus", "pos", "side", "sum", "n", F.when(F.col("n") > 0, F.col("sum") / F.col("n")).alias("metric"), F.abs(F.col("pos") - F.col("at.pos")).alias("distance"), "s0", "n0")


def search(breakpoints: DataFrame, limits: DataFrame, pairs: DataFrame, loci: DataFrame, totals: DataFrame, partitions: DataFrame | None = None) -> DataFrame:
    """chrom, idx, locus, refined, sum, n_zero, metric of every breakpoint.

    The best position is strictly better than the raw set's metric; to the
    right the nearest of the least, then to the left one that is strictly
    better still, or as good and nearer. None better: refined is the locus. No
    search possible (bad window, n_zero <= 0): refined is the locus and metric
    null.
    """
    spans = windows(breakpoints, limits, partitions)
    usable = valid(spans).join(totals, "chrom").filter("n_zero > 0").drop("sum", "n_zero", "n_nonzero")
    tested = curves(usable, pairs, loci, totals).filter("n > 0")
    base = F.col("s0") / F.col("n0")
    best = lambda side: tested.filter((F.col("side") == side) & (F.col("metric") < base)).groupBy("chrom", "idx").agg(F.min(F.struct("metric", "distance", "pos", "sum", "n")).alias(side))
    rows = spans.join(usable.select("chrom", "idx", F.lit(True).alias("ok")), ["chrom", "idx"], "left").join(best("right"), ["chrom", "idx"], "left").join(best("left"), ["chrom", "idx"], "left").join(totals, "chrom", "left")
    to_left = F.col("left").isNotNull() & (F.col("right").isNull() | (F.col("left.metric") < F.col("right.metric")) | ((F.col("left.metric") == F.col("right.metric")) & (F.col("left.distance") < F.col("right.distance"))))
    pick = F.when(to_left, F.col("left")).otherwise(F.col("right"))
    rows = rows.withColumn("pick", pick)
    base_metric = F.when(F.col("n_zero") > 0, F.col("sum") / F.col("n_zero"))
    return rows.select("chrom", "idx", "locus", F.coalesce("pick.pos", "locus").alias("refined"), F.coalesce("pick.sum", F.when(F.col("ok"), F.col("sum"))).alias("sum"), F.coalesce("pick.n", F.when(F.col("ok"), F.col("n_zero"))).alias("n_zero"), F.coalesce("pick.metric", F.when(F.col("ok"), base_metric)).alias("metric"))
