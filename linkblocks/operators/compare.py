"""Comparing runs, maps, matrices and block sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import intervals


def compare_covariance(a: DataFrame, b: DataFrame) -> DataFrame:
    """chrom, lo, hi, left_value, right_value of both matrices' pairs: a full outer join on the key."""
    return a.select("chrom", "lo", "hi", F.col("shrink_ld").alias("left_value")).join(b.select("chrom", "lo", "hi", F.col("shrink_ld").alias("right_value")), ["chrom", "lo", "hi"], "full_outer")


def covariance_difference(joined: DataFrame) -> DataFrame:
    gap = F.abs(F.col("left_value") - F.col("right_value"))
    both = F.col("left_value").isNotNull() & F.col("right_value").isNotNull()
    return joined.groupBy("chrom").agg(F.count_if(both).alias("shared"), F.count_if(F.col("right_value").isNull()).alias("only_left"), F.count_if(F.col("left_value").isNull()).alias("only_right"), F.max(gap).alias("max_diff"), F.avg(gap).alias("mean_diff"), F.count_if(both & (gap == 0)).alias("equal"))


def top_mismatches(joined: DataFrame, n: int = 20) -> DataFrame:
    gap = F.abs(F.col("left_value") - F.col("right_value"))
    return joined.withColumn("diff", gap).filter("diff > 0").orderBy(F.desc("diff"), "chrom", "lo", "hi").limit(n)


def overlap_duplicates(cov: DataFrame, partitions: DataFrame) -> DataFrame:
    """chrom, p_index, overlap_bp, shared, differing: neighbouring partitions, and the pairs both hold."""
    along = Window.partitionBy("chrom").orderBy("p_index")
    steps = partitions.withColumn("next_start", F.lead("start").over(along)).withColumn("next_index", F.lead("p_index").over(along)).filter("next_index is not null")
    left = cov.select("chrom", "p_index", "lo", "hi", F.col("shrink_ld").alias("x"))
    right = cov.select("chrom", F.col("p_index").alias("next_index"), "lo", "hi", F.col("shrink_ld").alias("y"))
    both = left.join(steps.select("chrom", "p_index", "next_index"), ["chrom", "p_index"]).join(right, ["chrom", "next_index", "lo", "hi"]).groupBy("chrom", "p_index").agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("x") != F.col("y")).alias("differing"))
    return steps.join(both, ["chrom", "p_index"], "left").select("chrom", "p_index", F.greatest(F.col("end") - F.col("next_start"), F.lit(0)).alias("overlap_bp"), F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("differing", F.lit(0)).alias("differing"))


def compare_vectors(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("chrom", "pos", F.col("value").alias("x")).join(b.select("chrom", "pos", F.col("value").alias("y")), ["chrom", "pos"], "full_outer")
    gap = F.abs(F.col("x") - F.col("y"))
    return both.groupBy("chrom").agg(F.count(gap).alias("shared"), F.count_if(F.col("y").isNull()).alias("only_left"), F.count_if(F.col("x").isNull()).alias("only_right"), F.max(gap).alias("max_diff"), F.avg(gap).alias("mean_diff"), F.coalesce(F.max(gap) == 0, F.lit(False)).alias("exact"))


def compare_positions(a: DataFrame, b: DataFrame) -> DataFrame:
    """chrom, records, unique and duplicate counts of both, shared, only_left, only_right, jaccard of position lists."""
    count = lambda d, c: d.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias(c))
    both = count(a, "x").join(count(b, "y"), ["chrom", "pos"], "full_outer")
    shared = F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull())
    return both.groupBy("chrom").agg(F.coalesce(F.sum("x"), F.lit(0)).alias("left_records"), F.count("x").alias("left_unique"), F.coalesce(F.sum("y"), F.lit(0)).alias("right_records"), F.count("y").alias("right_unique"), shared.alias("shared"), F.count_if(F.col("y").isNull()).alias("only_left"), F.count_if(F.col("x").isNull()).alias("only_right"), (shared / F.count(F.lit(1))).alias("jaccard"), F.count_if(F.col("x") > 1).alias("left_duplicated"), F.count_if(F.col("y") > 1).alias("right_duplicated"))


def breakpoint_run_summary(raw: DataFrame, refined: DataFrame) -> DataFrame:
    """chrom, n_raw, n_refined, unchanged of two breakpoint sets (chrom, idx, locus)."""
    both = raw.select("chrom", "idx", F.col("locus").alias("a")).join(refined.select("chrom", "idx", F.col("locus").alias("b")), ["chrom", "idx"], "full_outer")
    return both.groupBy("chrom").agg(F.count("a").alias("n_raw"), F.count("b").alias("n_refined"), F.count_if(F.col("a") == F.col("b")).alias("unchanged"))


def offset_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """chrom, direction, pos, nearest, offset (signed), distance, both ways."""
    one = lambda x, y, name: intervals.nearest(x, y).filter("nearest is not null").select("chrom", F.lit(name).alias("direction"), "pos", "nearest", (F.col("nearest") - F.col("pos")).alias("offset"), "distance")
    return one(a, b, "ours_to_ref").unionByName(one(b, a, "ref_to_ours"))


def classify_mismatches(a: DataFrame, b: DataFrame, b_blocks: DataFrame, source: str = "ours_to_ref") -> DataFrame:
    """chrom, pos, nearest, class of each boundary of a (chrom, pos) against boundaries b and their blocks."""
    near = intervals.nearest(a, b)
    back = intervals.nearest(b, a).select("chrom", F.col("pos").alias("nearest"), F.col("nearest").alias("returned"))
    edges = a.groupBy("chrom").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    inside = containing(a, b_blocks).select("chrom", "pos", F.lit(True).alias("inside"))
    rows = near.join(back, ["chrom", "nearest"], "left").join(edges, "chrom").join(inside, ["chrom", "pos"], "left")
    kind = (
        F.when(F.col("nearest").isNull(), "unmatched_boundary")
        .when(F.col("returned") == F.col("pos"), "shifted_boundary")
        .when((F.col("pos") == F.col("first")) | (F.col("pos") == F.col("last")), "chromosome_edge_mismatch")
        .when(F.col("inside"), "extra_split" if source == "ours_to_ref" else "missing_split")
        .otherwise("nonreciprocal_boundary")
    )
    return rows.select("chrom", "pos", "nearest", kind.alias("class"))


def containing(points: DataFrame, blocks: DataFrame, bin_size: int = 1_000_000) -> DataFrame:
    """chrom, pos, start, stop: the first block with start < pos < stop. Equi-join on bins."""
    rows = blocks.filter("start < stop").withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("stop") / bin_size))))
    hits = points.select("chrom", "pos").withColumn("bin", F.floor(F.col("pos") / bin_size)).join(rows, ["chrom", "bin"]).filter("start < pos and pos < stop")
    return hits.groupBy("chrom", "pos").agg(F.min(F.struct("start", "stop")).alias("b")).select("chrom", "pos", "b.*")


def adjacent(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """chrom, pos, left_start, right_stop: blocks that end and begin at each position."""
    left = blocks.groupBy("chrom", F.col("stop").alias("pos")).agg(F.max("start").alias("left_start"))
    right = blocks.groupBy("chrom", F.col("start").alias("pos")).agg(F.max("stop").alias("right_stop"))
    return points.select("chrom", "pos").distinct().join(left, ["chrom", "pos"], "left").join(right, ["chrom", "pos"], "left")


def in_window(points: DataFrame, blocks: DataFrame, window: int) -> DataFrame:
    """chrom, pos, start, stop of the blocks that touch pos +- window. Equi-join on bins of a window's width."""
    size = max(1, window)
    rows = blocks.withColumn("bin", F.explode(F.sequence(F.floor((F.col("start") - window) / size), F.floor((F.col("stop") + window) / size))))
    return points.select("chrom", "pos").withColumn("bin", F.floor(F.col("pos") / size)).join(rows, ["chrom", "bin"]).filter((F.col("stop") >= F.col("pos") - window) & (F.col("start") <= F.col("pos") + window)).select("chrom", "pos", "start", "stop")


def local_density(points: DataFrame, gmap: DataFrame, window: int) -> DataFrame:
    """chrom, pos, n, cm_span of the map positions within pos +- window. Equi-join on bins of a window's width."""
    size = max(1, window)
    wide = points.select("chrom", "pos").distinct().withColumn("bin", F.explode(F.sequence(F.floor((F.col("pos") - window) / size), F.floor((F.col("pos") + window) / size))))
    rows = gmap.select("chrom", F.col("pos").alias("at"), "cm").withColumn("bin", F.floor(F.col("at") / size))
    hits = wide.join(rows, ["chrom", "bin"]).filter(F.abs(F.col("at") - F.col("pos")) <= window).groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("n"), (F.max("cm") - F.min("cm")).alias("cm_span"))
    return points.select("chrom", "pos").distinct().join(hits, ["chrom", "pos"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def classify_stage(rows: DataFrame, raw: str, refined: str, tolerance: int) -> DataFrame:
    """rows with stage: how a boundary's distance changed from the raw to the refined set."""
    a, b = F.col(raw), F.col(refined)
    kind = (  # fixed values: the names of the stages
        F.when(a.isNull() | b.isNull(), "missing_stage")
        .when((a <= tolerance) & (b <= tolerance), "both_close")
        .when(a <= tolerance, "local_search_moved_away")
        .when(b <= tolerance, "local_search_improved")
        .when(b < a, "local_search_improved_but_still_far")
        .when(b > a, "local_search_worsened_already_shifted")
        .otherwise("fourier_already_shifted")
    )
    return rows.withColumn("stage", kind)


def boundary_diagnostics(a: DataFrame, a_blocks: DataFrame, b: DataFrame, b_blocks: DataFrame, gmap: DataFrame, window: int, source: str = "ours_to_ref") -> DataFrame:
    """One row a boundary of a: nearest of b, class, blocks beside and around it on both sides, map density."""
    near = intervals.nearest(a, b).withColumn("offset", F.col("nearest") - F.col("pos"))
    out = near.join(classify_mismatches(a, b, b_blocks, source).select("chrom", "pos", "class"), ["chrom", "pos"])
    out = out.join(adjacent(a, a_blocks), ["chrom", "pos"], "left")
    held = containing(a, b_blocks).select("chrom", "pos", F.col("start").alias("ref_start"), F.col("stop").alias("ref_stop"))
    around = in_window(a, b_blocks, window).groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("ref_blocks_in_window"))
    density = local_density(a, gmap, window).select("chrom", "pos", F.col("n").alias("map_points"), "cm_span")
    point = intervals.nearest(a, gmap.select("chrom", "pos")).select("chrom", "pos", F.col("nearest").alias("nearest_map_pos"), F.col("distance").alias("map_distance"))
    return out.join(held, ["chrom", "pos"], "left").join(around, ["chrom", "pos"], "left").join(density, ["chrom", "pos"], "left").join(point, ["chrom", "pos"], "left").withColumn("source", F.lit(source)).withColumn("window", F.lit(window)).withColumn("ref_blocks_in_window", F.coalesce("ref_blocks_in_window", F.lit(0)))


def compare_blocks(ours: DataFrame, reference: DataFrame, tolerance: int = 10_000, curve: tuple[int, ...] = (1_000, 5_000, 10_000, 25_000, 50_000, 100_000)) -> DataFrame:
    """One row a chromosome: sizes, recall, precision, Jaccards, offsets of both sets, and the recall at each tolerance of the curve."""
    a, b = intervals.boundaries(ours), intervals.boundaries(reference)
    named = lambda d, names: d.withColumnsRenamed(names)
    own = named(intervals.size_stats(ours), {"n": "our_n", "mean_kb": "our_mean_kb", "median_kb": "our_median_kb"}).drop("p5_kb", "p95_kb")
    ref = named(intervals.size_stats(reference), {"n": "ref_n", "mean_kb": "ref_mean_kb", "median_kb": "ref_median_kb"}).drop("p5_kb", "p95_kb")
    rate = lambda x, y, t, name: intervals.match_rate(x, y, t).select("chrom", F.round("rate", 4).alias(name))
    out = own.join(ref, "chrom", "full_outer").na.fill(0, ["our_n", "ref_n"])
    for part in (
        rate(a, b, tolerance, "recall"),
        rate(b, a, tolerance, "precision"),
        intervals.boundary_jaccard(a, b, tolerance).select("chrom", F.round("jaccard", 4).alias("jaccard")),
        named(intervals.offset_stats(a, b), {"median_kb": "our_median_offset_kb", "p90_kb": "our_p90_offset_kb"}),
        named(intervals.offset_stats(b, a), {"median_kb": "ref_median_offset_kb", "p90_kb": "ref_p90_offset_kb"}),
        intervals.bp_jaccard(ours, reference).withColumnRenamed("jaccard", "bp_jaccard"),
        *[rate(a, b, t, f"recall_{t}") for t in curve],
    ):
        out = out.join(part, "chrom", "left")
    return out


def digest(rows: DataFrame, *order: str, run: int = 10_000) -> DataFrame:
    """chrom, digest: equal digests mean equal contents.

    Rows are numbered in order; the SHA-256 of each run of `run` rows, and then
    the SHA-256 of a chromosome's run digests, one a line. So no more than a
    run, or a chromosome's run digests, is put together.
    """
    text = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns if c != "chrom"])
    numbered = rows.select("chrom", text.alias("_t"), F.row_number().over(Window.partitionBy("chrom").orderBy(*order, text)).alias("_n"))
    joined = lambda at, value: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, value))), lambda s: s[value]), "\n"), 256)
    runs = numbered.groupBy("chrom", F.floor((F.col("_n") - 1) / run).alias("_r")).agg(joined("_n", "_t").alias("_d"))
    return runs.groupBy("chrom").agg(joined("_r", "_d").alias("digest"))


def compare_beds(each: DataFrame, whole: DataFrame) -> DataFrame:
    """chrom, row_no and both values where two block lists (chrom, row_no, start, stop) differ first."""
    both = each.select("chrom", "row_no", F.struct("start", "stop").alias("a")).join(whole.select("chrom", "row_no", F.struct("start", "stop").alias("b")), ["chrom", "row_no"], "full_outer")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).groupBy("chrom").agg(F.min(F.struct("row_no", "a", "b")).alias("f")).select("chrom", "f.*")


def anchor_pairs(panel: DataFrame, stride: int, reach: int, per_anchor: int) -> DataFrame:
    """chrom, anchor, pos: every stride-th position with the next per_anchor ones within reach (ranks make it an equi-join)."""
    along = Window.partitionBy("chrom").orderBy("pos")
    ranked = panel.select("chrom", "pos").distinct().withColumn("r", F.row_number().over(along) - 1)
    anchors = ranked.filter(F.col("r") % stride == 0).select("chrom", F.col("pos").alias("anchor"), F.explode(F.sequence(F.col("r") + 1, F.col("r") + per_anchor)).alias("r"))
    return anchors.join(ranked, ["chrom", "r"]).filter(F.col("pos") - F.col("anchor") <= reach).select("chrom", "anchor", "pos")


def naive_r2(pairs: DataFrame, panel: DataFrame, least: int = 10) -> DataFrame:
    """chrom, anchor, pos, maf_a, maf_b, r2: squared Pearson correlation of both haplotype rows; null where either is constant or fewer than `least` calls."""
    side = lambda c, s: panel.select("chrom", F.col("pos").alias(c), F.col("haps").alias(f"h{s}"))
    rows = pairs.join(side("anchor", 1), ["chrom", "anchor"]).join(side("pos", 2), ["chrom", "pos"])
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    n = F.size("h1").cast("double")
    rows = rows.withColumn("n", n).withColumn("a", total(F.col("h1"))).withColumn("b", total(F.col("h2"))).withColumn("ab", total(F.zip_with("h1", "h2", lambda x, y: x * y)))
    cov = F.col("ab") / n - (F.col("a") / n) * (F.col("b") / n)
    va, vb = F.col("a") / n * (1 - F.col("a") / n), F.col("b") / n * (1 - F.col("b") / n)
    maf = lambda c: F.least(F.col(c) / n, 1 - F.col(c) / n)
    return rows.select("chrom", "anchor", "pos", maf("a").alias("maf_a"), maf("b").alias("maf_b"), F.when((F.col("n") >= least) & (va > 0) & (vb > 0), cov * cov / (va * vb)).alias("r2"))
