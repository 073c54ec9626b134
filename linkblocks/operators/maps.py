"""Genetic maps: interpolation, partitioning into windows, quality. Map rows: chrom, row_no, pos, rate, cum_cm."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import NE

MODES = ("point", "interval", "hapmap", "macdonald-decode", "macdonald-pyrho")


def _as_of(snps: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """snps with `at`: the last map row (struct of columns) with pos <= the SNP's, and `next`: the first with pos >= it.

    Both sides are sorted together once; nothing is compared pairwise.
    """
    row = F.struct(F.col("pos").alias("pos"), *columns)
    marks = rows.select("chrom", "pos", F.lit(0).alias("kind"), row.alias("row"), F.col("row_no").alias("n"))
    points = snps.select("chrom", "pos", F.lit(1).alias("kind"), F.lit(None).cast(marks.schema["row"].dataType).alias("row"), F.col("row_no").alias("n"), F.struct(*[c for c in snps.columns]).alias("snp"))
    both = marks.withColumn("snp", F.lit(None).cast(points.schema["snp"].dataType)).unionByName(points)
    back = Window.partitionBy("chrom").orderBy("pos", "kind", "n").rowsBetween(Window.unboundedPreceding, 0)
    # backwards, since a frame that ends at the last row is summed anew for each row
    ahead = Window.partitionBy("chrom").orderBy(F.desc("pos"), "kind", F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("at", F.last("row", ignorenulls=True).over(back)).withColumn("next", F.last("row", ignorenulls=True).over(ahead))
    return found.filter("kind = 1").select("snp.*", "at", "next")


def interpolate(snps: DataFrame, rows: DataFrame, mode: str = "point") -> DataFrame:
    """snps (chrom, row_no, pos, rs_id) with cm.

    point: linear between map rows, 0 before the first, the last value after
    the last. interval: a row's rate holds from its position on, starting at
    the row before's cumulative value (0 for the first row). hapmap: the same
    from its own value. macdonald-decode: interval with the first row moved to
    0. macdonald-pyrho: that, and the last row's rate becomes the last SNP + 1
    where the last SNP exceeds that rate.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    along = Window.partitionBy("chrom").orderBy("row_no")
    rows = rows.withColumn("before_cm", F.lag("cum_cm", 1, 0.0).over(along)).withColumn("ends", F.lead("row_no").over(along).isNull()).withColumn("begins", F.lag("row_no").over(along).isNull())
    if mode.startswith("macdonald"):
        rows = rows.withColumn("pos", F.when(F.col("begins"), F.lit(0)).otherwise(F.col("pos")).cast("bigint"))
    if mode == "macdonald-pyrho":
        last = snps.groupBy("chrom").agg(F.max_by("pos", "row_no").alias("last_snp"))
        rows = rows.join(last, "chrom", "left").withColumn("rate", F.when(F.col("ends") & (F.col("last_snp") > F.col("rate")), F.col("last_snp") + 1.0).otherwise(F.col("rate"))).drop("last_snp")
    found = _as_of(snps, rows, ["rate", "cum_cm", "before_cm"])
    pos = F.col("pos")
    if mode == "point":
        share = (pos - F.col("at.pos")) / (F.col("next.pos") - F.col("at.pos"))
        between = F.col("at.cum_cm") + share * (F.col("next.cum_cm") - F.col("at.cum_cm"))
        cm = F.when(F.col("next").isNotNull() & (F.col("next.pos") == pos), F.col("next.cum_cm")).when(F.col("at").isNull(), 0.0).when(F.col("next").isNull(), F.col("at.cum_cm")).otherwise(between)
    else:
        start = F.col("at.cum_cm") if mode == "hapmap" else F.col("at.before_cm")
        cm = F.when(F.col("at").isNull(), 0.0).otherwise(start + (pos - F.col("at.pos")) * F.col("at.rate") / 1e6)
    return found.withColumn("cm", cm).drop("at", "next")


def backward_steps(interpolated: DataFrame) -> DataFrame:
    """SNPs whose cm is below the one before, for a warning."""
    before = F.lag("cm").over(Window.partitionBy("chrom").orderBy("row_no"))
    return interpolated.withColumn("before", before).filter("cm < before")


def partition_chromosome(gmap: DataFrame, n_individuals: int, window: int = 5000, ne: float = NE, cutoff: float = 1.5e-8) -> DataFrame:
    """chrom, p_index, start, end: overlapping windows of about `window` positions (gmap: chrom, pos, cm, in order of row_no).

    A window reaches on, from the second position after it, until the decay
    from its last position falls below the cutoff; steps backwards are passed
    over. The last window goes to the end. A chromosome of fewer positions
    than one window is one partition.
    """

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row_no")
        pos, cm = group["pos"].to_numpy(), group["cm"].to_numpy(float)
        n, out = len(pos), []
        chunks = n // window
        for k in range(chunks):
            stop = n - 1
            if k < chunks - 1:
                gap = cm[(k + 1) * window + 1 :] - cm[(k + 1) * window - 1]
                far = np.flatnonzero((gap >= 0) & (np.exp(np.minimum(-4.0 * ne * gap / (2.0 * n_individuals), 0.0)) < cutoff))
                stop = min((k + 1) * window + 1 + (int(far[0]) if len(far) else n), n - 1)
            out.append((k, pos[k * window], pos[stop]))
        if not chunks and n:
            out.append((0, pos[0], pos[-1]))
        return pd.DataFrame({"chrom": group["chrom"].iloc[0], "p_index": [o[0] for o in out], "start": [o[1] for o in out], "end": [o[2] for o in out]})

    return gmap.select("chrom", "row_no", "pos", "cm").groupBy("chrom").applyInPandas(cut, "chrom string, p_index int, start bigint, end bigint")


def map_quality(gmap: DataFrame) -> DataFrame:
    """chrom, n_snps, cm_min, cm_max, cm_range, snps_per_cm, inversions, gap_median_cm, gap_max_cm (gaps above 0)."""
    before = F.lag("cm").over(Window.partitionBy("chrom").orderBy("row_no"))
    gaps = gmap.withColumn("gap", F.col("cm") - before)
    up = F.when(F.col("gap") > 0, F.col("gap"))
    span = F.max_by("cm", "row_no") - F.min_by("cm", "row_no")
    return gaps.groupBy("chrom").agg(
        F.count(F.lit(1)).alias("n_snps"),
        F.round(F.min_by("cm", "row_no"), 4).alias("cm_min"),
        F.round(F.max_by("cm", "row_no"), 4).alias("cm_max"),
        F.round(span, 4).alias("cm_range"),
        F.round(F.count(F.lit(1)) / F.when(span > 0, span), 2).alias("snps_per_cm"),
        F.count_if(F.col("gap") < 0).alias("inversions"),
        F.round(F.coalesce(F.percentile(up, 0.5), F.lit(0.0)), 6).alias("gap_median_cm"),
        F.round(F.coalesce(F.max(up), F.lit(0.0)), 6).alias("gap_max_cm"),
    )


def partition_summary(partitions: DataFrame) -> DataFrame:
    width = F.col("end") - F.col("start")
    return partitions.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first_start"), F.max("end").alias("last_end"), F.avg(width).alias("mean_width"), F.percentile(width, 0.5).alias("median_width"), F.min(width).alias("min_width"), F.max(width).alias("max_width"))


def compare_maps(a: DataFrame, b: DataFrame, threshold: float = 0.01) -> DataFrame:
    """chrom, shared, only_a, only_b, pearson, mae, max_error, share_over of two maps (chrom, pos, cm)."""
    both = a.select("chrom", "pos", F.col("cm").alias("x")).join(b.select("chrom", "pos", F.col("cm").alias("y")), ["chrom", "pos"], "full_outer")
    error = F.abs(F.col("x") - F.col("y"))
    return both.groupBy("chrom").agg(F.count(F.col("x") + F.col("y")).alias("shared"), F.count_if(F.col("y").isNull()).alias("only_a"), F.count_if(F.col("x").isNull()).alias("only_b"), F.corr("x", "y").alias("pearson"), F.avg(error).alias("mae"), F.max(error).alias("max_error"), F.avg((error > threshold).cast("double")).alias("share_over"))


def decode_rows(raw: DataFrame) -> DataFrame:
    """Map rows of a deCODE-like table (chrom, begin, end, rate, cm): one row an interval, in order of begin."""
    along = Window.partitionBy("chrom").orderBy("begin")
    return raw.select("chrom", (F.row_number().over(along) - 1).cast("bigint").alias("row_no"), F.col("begin").cast("bigint").alias("pos"), F.col("rate").cast("double").alias("rate"), F.col("cm").cast("double").alias("cum_cm"))


def pyrho_rows(raw: DataFrame) -> DataFrame:
    """Map rows of a table whose columns are named in one of several ways; ValueError if one is missing or cM falls."""
    names = {c.lower().lstrip("#"): c for c in raw.columns}
    pick = lambda *options: next((names[o] for o in options if o in names), None)
    wanted = {"chrom": pick("chrom", "chromosome", "chr"), "pos": pick("position(bp)", "position", "pos", "start"), "rate": pick("rate(cm/mb)", "rate", "recomb_rate"), "cum_cm": pick("map(cm)", "map", "cm", "cum_cm")}
    missing = [k for k, v in wanted.items() if v is None]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    rows = raw.select(F.col(f"`{wanted['chrom']}`").cast("string").alias("chrom"), F.col(f"`{wanted['pos']}`").cast("bigint").alias("pos"), F.col(f"`{wanted['rate']}`").cast("double").alias("rate"), F.col(f"`{wanted['cum_cm']}`").cast("double").alias("cum_cm"))
    along = Window.partitionBy("chrom").orderBy("pos")
    rows = rows.withColumn("row_no", (F.row_number().over(along) - 1).cast("bigint"))
    if rows.withColumn("b", F.lag("cum_cm").over(along)).filter("cum_cm < b").limit(1).count():
        raise ValueError("cumulative cM falls")
    return rows
