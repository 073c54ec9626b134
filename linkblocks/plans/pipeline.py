"""The driver programs: from a panel to blocks, and the search for breakpoint sets."""

from __future__ import annotations

import json
import os
import warnings
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import covariance, intervals, local_search, maps, metric, signal, vector
from ..sources import sinks, text
from ..sources.store import CovarianceStore
from .scratch import materialize

SUBSETS = ("fourier", "fourier_ls", "uniform", "uniform_ls")
NEEDS = {"fourier_ls": "fourier", "uniform_ls": "uniform"}


@dataclass
class Breakpoints:
    """sets: chrom, subset, idx, locus. metrics: chrom, subset, sum, n_nonzero, n_zero, unrefined_count. widths: chrom, n_bpoints, found_width."""

    sets: DataFrame
    metrics: DataFrame
    widths: DataFrame


def find_breakpoints(cov: DataFrame, partitions: DataFrame, n_bpoints: int | None = None, between: int = 10_000, subsets: tuple[str, ...] = ("fourier_ls",), vector_frame: DataFrame | None = None, search: dict | None = None, first: int | None = None, last: int | None = None, periodic: bool = False) -> Breakpoints:
    """Breakpoint sets of every chromosome.

    The width search is data dependent: a driver loop, each round one job over
    the vectors. Raw sets, local search and metrics of all chromosomes are one
    plan each. Only subsets asked for, and what they need, are computed.
    """
    unknown = set(subsets) - set(SUBSETS)
    if unknown:
        raise ValueError(f"unknown subsets: {', '.join(sorted(unknown))}")
    wanted = {*subsets, *(NEEDS[s] for s in subsets if s in NEEDS)}
    spark = cov.sparkSession
    whole = materialize(vector_frame if vector_frame is not None else vector.to_vector(cov, partitions), "vector")
    inside = whole
    if first is not None:
        inside = inside.filter(F.col("pos") >= first)
    if last is not None:
        inside = inside.filter(F.col("pos") <= last)
    sizes = {r["chrom"]: r["n"] for r in inside.groupBy("chrom").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a chromosome
    targets = {c: n_bpoints if n_bpoints is not None else signal.target_minima(n, between) for c, n in sizes.items()}
    widths = signal.search_widths(inside, targets, **(search or {}))
    width_rows = spark.createDataFrame([(c, targets[c], w) for c, w in widths.items()], "chrom string, n_bpoints int, found_width int")
    found = signal.minima_positions(signal.smooth(inside, {c: [w] for c, w in widths.items()}, periodic))
    numbered = Window.partitionBy("chrom").orderBy("locus")
    sets = {"fourier": found.select("chrom", (F.row_number().over(numbered) - 1).cast("bigint").alias("idx"), "locus")}
    sets["fourier"] = materialize(sets["fourier"], "fourier")
    if "uniform" in wanted:
        counts = sets["fourier"].groupBy("chrom").agg(F.count(F.lit(1)).alias("k"))
        sets["uniform"] = materialize(signal.uniform_breakpoints(whole, counts).select("chrom", F.col("idx").cast("bigint").alias("idx"), "locus"), "uniform")
    mine = covariance.owned(cov, partitions, first, last)
    pairs = materialize(covariance.normalized(cov, partitions, keep_diagonal=True), "correlations")
    loci = materialize(mine.select("chrom", F.col("lo").alias("pos")).distinct(), "loci")
    limits = vector.default_range(partitions).select("chrom", (F.lit(first) if first is not None else F.col("snp_first")).alias("snp_first"), (F.lit(last) if last is not None else F.col("snp_last")).alias("snp_last"), F.col("snp_first").alias("range_start"), F.col("snp_last").alias("range_end"))
    off = pairs.filter("lo < hi")
    metrics = []
    for name in ("fourier", "uniform"):
        if name not in wanted:
            continue
        raw = materialize(metric.metric(off, loci, sets[name]), "metric")
        metrics.append(raw.withColumn("subset", F.lit(name)).withColumn("unrefined_count", F.lit(None).cast("bigint")))
        if f"{name}_ls" in wanted:
            moved = materialize(local_search.search(sets[name], limits, pairs, loci, raw, partitions), "refined")
            sets[f"{name}_ls"] = moved.select("chrom", "idx", F.col("refined").alias("locus"))
            left = metric.unrefined(moved).withColumnRenamed("unrefined", "unrefined_count")
            metrics.append(metric.metric(off, loci, sets[f"{name}_ls"]).join(left, "chrom", "left").withColumn("subset", F.lit(f"{name}_ls")))
    out = None
    for name in SUBSETS:
        if name in wanted:
            own = sets[name].withColumn("subset", F.lit(name)).select("chrom", "subset", "idx", "locus")
            out = own if out is None else out.unionByName(own)
    summed = None
    for m in metrics:
        m = m.select("chrom", "subset", "sum", "n_nonzero", "n_zero", "unrefined_count")
        summed = m if summed is None else summed.unionByName(m)
    return Breakpoints(out, summed, width_rows)


def _same_parameters(spark: SparkSession, path: str, values: dict) -> bool:
    """Whether `path` holds these parameters of an earlier run."""
    want = json.dumps(values, sort_keys=True)
    try:
        return [r[0] for r in spark.read.text(path).collect()] == [want]
    except AnalysisException:  # not written yet
        return False


def run(spark: SparkSession, vcf: str, genetic_map: str, output: str, individuals: str | None = None, region: str | None = None, ne: float = scalar.NE, cutoff: float = 1e-7, window: int = 5000, n_bpoints: int | None = None, between: int = 10_000, subset: str = "fourier_ls", full: bool = False, force: bool = False, keep_covariance: bool = True, search: dict | None = None) -> dict[str, str]:
    """A text VCF and its genetic map to blocks: every stage's output under `output`.

    All chromosomes of the file run together; partitions and vectors are
    written in a folder for each. Finished partitions are not computed again if
    the parameters they depend on are the same.
    """
    chosen = [r["sample"] for r in text.read_individuals(spark, individuals).orderBy("ord").collect()] if individuals else text.vcf_samples(spark, vcf)
    found = text.read_vcf(spark, vcf, chosen, region)
    gmap = text.map_of(found, text.read_genetic_map(spark, genetic_map))
    variants = text.usable(found.join(gmap.select("chrom", "pos", F.col("cm").alias("g")), ["chrom", "pos"]))
    panel = materialize(covariance.prepare_panel(variants), "panel")
    chroms = [r["chrom"] for r in panel.select("chrom").distinct().orderBy("chrom").collect()]  # one row a chromosome
    if not chroms:
        raise ValueError("no variants in the input")
    backward = [r["chrom"] for r in covariance.non_monotonic(panel).filter("inversions > 0").collect()]
    if backward:
        warnings.warn(f"the genetic map goes backwards on {', '.join(backward)}", stacklevel=2)
    for r in text.skip_counts(found).filter("unphased > 0 or duplicates > 0").collect():
        warnings.warn(f"{r['chrom']}: {r['unphased']} unphased or incomplete records and {r['duplicates']} repeated positions are left out", stacklevel=2)
    parts = materialize(maps.partition_chromosome(gmap, len(chosen), window, ne), "partitions")
    paths = {k: os.path.join(output, k) for k in ("partitions", "covariance", "vector", "breakpoints", "blocks", "parameters")}
    for c in chroms:
        sinks.write_partitions(parts, os.path.join(paths["partitions"], c), c)
    store = CovarianceStore(spark, paths["covariance"])
    size = panel.agg(F.sum(F.xxhash64("chrom", "pos", "g", "n1").cast("decimal(38,0)"))).first()[0]
    values = {"vcf": vcf, "map": genetic_map, "region": region, "samples": chosen, "ne": ne, "cutoff": cutoff, "window": window, "full": full, "panel": str(size)}
    have = store.present() if not force and _same_parameters(spark, paths["parameters"], values) else set()
    todo = [r for r in parts.collect() if (r["chrom"], r["p_index"]) not in have]  # one row a window
    if todo:
        if not have:
            store.delete()
        spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(paths["parameters"])
        wanted = spark.createDataFrame([tuple(r) for r in todo], parts.schema)
        store.write(covariance.by_partition(covariance.covariance(panel, 2 * len(chosen), len(chosen), ne, cutoff, full), wanted))
    cov = store.read(full)
    signal_frame = materialize(vector.to_vector(cov, parts), "vector")
    for c in chroms:
        sinks.write_vector(signal_frame, os.path.join(paths["vector"], c), c)
    made = find_breakpoints(cov, parts, n_bpoints, between, (subset,), signal_frame, search)
    sinks.write_breakpoints(sinks.breakpoints_json(made.sets, made.widths, made.metrics, list(SUBSETS)), paths["breakpoints"])
    sinks.write_bed(intervals.blocks_of(made.sets.filter(F.col("subset") == subset), vector.default_range(parts)), paths["blocks"])
    if not keep_covariance:
        store.delete()
    return paths
