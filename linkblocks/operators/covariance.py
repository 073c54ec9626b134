"""Shrinkage covariance of nearby positions: a banded self-join with packed haplotypes.

panel: chrom, i (rank along the chromosome, from 0), pos, g (cM), words, n1.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar

#: Positions of one bin of the banded join.
BIN = 256


def prepare_panel(variants: DataFrame) -> DataFrame:
    """panel from chrom, pos, g, haps and record_no: the first record of a position wins, ranks follow positions."""
    first = Window.partitionBy("chrom", "pos").orderBy("record_no")
    along = Window.partitionBy("chrom").orderBy("pos")
    one = variants.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    packed = one.withColumn("words", scalar.pack(F.col("haps"))).withColumn("n1", scalar.ones(F.col("words")))
    return packed.withColumn("i", (F.row_number().over(along) - 1).cast("bigint"))


def non_monotonic(panel: DataFrame) -> DataFrame:
    """chrom, inversions of chromosomes whose map goes backwards somewhere."""
    before = F.lag("g").over(Window.partitionBy("chrom").orderBy("i"))
    return panel.withColumn("_b", before).groupBy("chrom").agg(F.count_if(F.col("g") < F.col("_b")).alias("inversions")).filter("inversions > 0")


def _next_beyond(g: np.ndarray, reach: float, n_individuals: int, ne: float, cutoff: float) -> np.ndarray:
    """For each index the first later one whose exponent is below ln(cutoff), on a map that may go backwards."""
    n, limit = len(g), math.log(cutoff)
    out = np.full(n, n, np.int64)
    size = 512
    peak = [g[a : a + size].max() for a in range(0, n, size)]
    for i in range(n):
        j = i
        while j < n:
            block = j // size
            if g[i] + reach > peak[block] and not (peak[block] - g[i] > reach * (1 - 1e-12)):
                j = (block + 1) * size
                continue
            end = min(n, (block + 1) * size)
            hits = np.flatnonzero(-4.0 * ne * (g[j:end] - g[i]) / (2.0 * n_individuals) < limit)
            if len(hits):
                out[i] = j + hits[0]
                break
            j = end
    return out


def window_stops(panel: DataFrame, n_individuals: int, ne: float = scalar.NE, cutoff: float = 1e-7, assume_monotonic: bool | None = None) -> DataFrame:
    """panel with stop: the first rank from i on whose decay is below the cutoff (one past the last rank if none).

    Where no map goes backwards a range frame over g counts the prefix. A map
    that does needs the prefix itself, not the pairs by distance: those
    chromosomes are scanned in order. cutoff <= 0 means no bound.
    """
    along = Window.partitionBy("chrom")
    if cutoff <= 0:
        return panel.withColumn("stop", F.count(F.lit(1)).over(along))
    reach = -math.log(cutoff) * 2.0 * n_individuals / (4.0 * ne)
    if assume_monotonic is None:
        assume_monotonic = not non_monotonic(panel).limit(1).count()
    if assume_monotonic:
        # a little too far on purpose; the pair predicate settles the edge
        frame = f"partition by chrom order by g range between unbounded preceding and {reach * (1 + 1e-9)!r}D following"
        return panel.withColumn("stop", F.expr(f"count(1) over ({frame})"))

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i")
        return pd.DataFrame({"chrom": group["chrom"].to_numpy(), "i": group["i"].to_numpy(), "stop": _next_beyond(group["g"].to_numpy(float), reach, n_individuals, ne, cutoff)})

    stops = panel.select("chrom", "i", "g").groupBy("chrom").applyInPandas(scan, "chrom string, i bigint, stop bigint")
    return panel.join(stops, ["chrom", "i"])


def nearby_pairs(panel: DataFrame, n_individuals: int, ne: float = scalar.NE, cutoff: float = 1e-7, extra: tuple[str, ...] = (), bins: int = BIN) -> DataFrame:
    """All pairs i <= j < stop(i), as columns with _a and _b: an equi-join on bins of ranks, each left row in the bins it reaches."""
    bounded = window_stops(panel, n_individuals, ne, cutoff)
    names = ["i", "pos", "g", "words", "n1", *extra]
    left = bounded.select("chrom", *[F.col(c).alias(f"{c}_a") for c in names], "stop").withColumn("bin", F.explode(F.sequence(F.floor(F.col("i_a") / bins), F.floor((F.greatest("stop", F.col("i_a") + 1) - 1) / bins))))
    right = panel.select("chrom", *[F.col(c).alias(f"{c}_b") for c in names]).withColumn("bin", F.floor(F.col("i_b") / bins))
    pairs = left.join(right, ["chrom", "bin"]).filter((F.col("i_b") >= F.col("i_a")) & ((F.col("i_b") < F.col("stop")) | (F.col("i_b") == F.col("i_a"))))
    if cutoff > 0:
        inside = scalar.exponent(F.col("g_b") - F.col("g_a"), n_individuals, ne) >= math.log(cutoff)
        pairs = pairs.filter(inside | (F.col("i_a") == F.col("i_b")))
    return pairs.drop("bin", "stop")


def covariance(panel: DataFrame, n_haplotypes: int, n_individuals: int, ne: float = scalar.NE, cutoff: float = 1e-7, full: bool = False) -> DataFrame:
    """chrom, lo, hi, shrink_ld of every pair whose shrunk covariance reaches the cutoff; full adds naive_ld, both cM and ids.

    The cutoff comes before the diagonal adjustment, so a position without
    variance is absent altogether.
    """
    theta = scalar.watterson_theta(n_haplotypes)
    pairs = nearby_pairs(panel, n_individuals, ne, cutoff, ("rs_id",) if full else ())
    naive = scalar.naive_covariance(scalar.common_ones(F.col("words_a"), F.col("words_b")), F.col("n1_a"), F.col("n1_b"), n_haplotypes)
    value = scalar.shrink(naive, scalar.decay(F.col("g_b") - F.col("g_a"), n_individuals, ne), theta)
    kept = pairs.withColumn("naive_ld", naive).withColumn("v", value).filter(F.abs("v") >= cutoff)
    adjusted = F.when(F.col("i_a") == F.col("i_b"), F.col("v") + scalar.diagonal_adjustment(theta)).otherwise(F.col("v"))
    more = [F.col("g_a").alias("i_gpos"), F.col("g_b").alias("j_gpos"), "naive_ld", F.col("rs_id_a").alias("i_id"), F.col("rs_id_b").alias("j_id")] if full else []
    return kept.select("chrom", F.col("pos_a").alias("lo"), F.col("pos_b").alias("hi"), adjusted.alias("shrink_ld"), *more)


def closed_form_diagonal(panel: DataFrame, n_haplotypes: int, cutoff: float = 1e-7) -> DataFrame:
    """chrom, pos, value of the diagonal from allele counts alone."""
    theta = scalar.watterson_theta(n_haplotypes)
    value = scalar.shrink(scalar.naive_covariance(F.col("n1"), F.col("n1"), F.col("n1"), n_haplotypes), F.lit(1.0), theta)
    return panel.withColumn("v", value).filter(F.abs("v") >= cutoff).select("chrom", "pos", (F.col("v") + scalar.diagonal_adjustment(theta)).alias("value"))


def by_partition(cov: DataFrame, partitions: DataFrame) -> DataFrame:
    """cov with p_index: a copy in every (overlapping) partition that holds both ends. Partitions are few per chromosome."""
    ranges = partitions.groupBy("chrom").agg(F.sort_array(F.collect_list(F.struct("p_index", "start", "end"))).alias("parts"))
    holding = F.filter("parts", lambda p: (F.col("lo") >= p["start"]) & (F.col("hi") <= p["end"]))
    return cov.join(F.broadcast(ranges), "chrom").withColumn("p_index", F.explode(F.transform(holding, lambda p: p["p_index"]))).drop("parts")  # one row a chromosome


def canonical(rows: DataFrame, order: list[str]) -> DataFrame:
    """lo <= hi, and of rows of one pair the first in `order`. From i, j, shrink_ld."""
    first = Window.partitionBy("chrom", "lo", "hi").orderBy(*order)
    ordered = rows.withColumn("lo", F.least("i", "j")).withColumn("hi", F.greatest("i", "j"))
    return ordered.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "i", "j")


def owned(cov: DataFrame, partitions: DataFrame, first: Column | int | None = None, last: Column | int | None = None) -> DataFrame:
    """Rows whose lower end their partition owns: from its start (not included, but for the first) to the next one's (included)."""
    along = Window.partitionBy("chrom").orderBy("p_index")
    whole = Window.partitionBy("chrom")
    low = F.lit(first) if isinstance(first, int) else F.min("start").over(whole) if first is None else first
    high = F.lit(last) if isinstance(last, int) else F.max("end").over(whole) if last is None else last
    bounds = partitions.select("chrom", "p_index", F.when(F.lag("start").over(along).isNull(), low).otherwise(F.col("start")).alias("own_lo"), F.coalesce(F.lead("start").over(along), high).alias("own_hi"), F.lag("start").over(along).isNull().alias("is_first"), low.alias("snp_first"), high.alias("snp_last"))
    rows = cov.join(bounds, ["chrom", "p_index"])
    mine = F.when(F.col("is_first"), F.col("lo") >= F.col("own_lo")).otherwise(F.col("lo") > F.col("own_lo")) & (F.col("lo") <= F.col("own_hi"))
    within = (F.col("lo") >= F.col("snp_first")) & (F.col("hi") <= F.col("snp_last"))
    return rows.filter(mine & within).select(*cov.columns)


def diagonals(cov: DataFrame) -> DataFrame:
    """chrom, pos, value: of several partitions' values the first."""
    order = Window.partitionBy("chrom", "lo").orderBy("p_index")
    rows = cov.filter("lo = hi")
    if "p_index" in cov.columns:
        rows = rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return rows.select("chrom", F.col("lo").alias("pos"), F.col("shrink_ld").alias("value"))


def correlations(cov: DataFrame, diag: DataFrame, keep_diagonal: bool = False) -> DataFrame:
    """chrom, lo, hi, r2 of pairs both of whose diagonals exist and are positive."""
    positive = diag.filter("value > 0")
    low = positive.select("chrom", F.col("pos").alias("lo"), F.col("value").alias("d_lo"))
    high = positive.select("chrom", F.col("pos").alias("hi"), F.col("value").alias("d_hi"))
    rows = cov if keep_diagonal else cov.filter("lo < hi")
    return rows.join(low, ["chrom", "lo"]).join(high, ["chrom", "hi"]).select("chrom", "lo", "hi", scalar.r_squared(F.col("shrink_ld"), F.col("d_lo"), F.col("d_hi")).alias("r2"))


def normalized(cov: DataFrame, partitions: DataFrame, keep_diagonal: bool = False) -> DataFrame:
    """A chromosome's correlations: owned rows, first diagonals, one row a pair."""
    mine = owned(cov, partitions)
    first = Window.partitionBy("chrom", "lo", "hi").orderBy("p_index")
    once = mine.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return correlations(once, diagonals(mine), keep_diagonal)


def symmetric(cov: DataFrame) -> DataFrame:
    """Both (lo, hi) and (hi, lo)."""
    return cov.select("chrom", "lo", "hi", "shrink_ld").unionByName(cov.filter("lo < hi").select("chrom", F.col("hi").alias("lo"), F.col("lo").alias("hi"), "shrink_ld"))


def correlation_matrix(cov: DataFrame, first: int, last: int) -> DataFrame:
    """chrom, lo, hi, r of a small range, for a heat map."""
    rows = cov.filter((F.col("lo") >= first) & (F.col("hi") <= last))
    d = diagonals(rows).filter("value > 0")
    low, high = (d.select("chrom", F.col("pos").alias(c), F.col("value").alias(f"d_{c}")) for c in ("lo", "hi"))
    return rows.join(low, ["chrom", "lo"]).join(high, ["chrom", "hi"]).select("chrom", "lo", "hi", (F.col("shrink_ld") / F.sqrt(F.col("d_lo") * F.col("d_hi"))).alias("r")).distinct()
