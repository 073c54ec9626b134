"""Command line: python -m linkblocks.cli COMMAND ... (run, partition-chromosome, calc-covariance, matrix-to-vector, find-minima, extract-bpoints, interpolate-maps, covariance-summary)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import scalar
from .operators import covariance, diagnostics, intervals, maps, vector
from .plans import pipeline
from .sources import sinks, text
from .sources.store import CovarianceStore


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="linkblocks")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> None:
        sub = commands.add_parser(name)
        for flag, kind, default in options:
            if kind is bool:
                sub.add_argument(flag, action="store_true")
            else:
                sub.add_argument(flag, type=kind, default=default, required=default is ...)

    ne, first, last = ("--ne", float, scalar.NE), ("--snp-first", int, None), ("--snp-last", int, None)
    command("run", ("--reference-panel", str, ...), ("--genetic-map", str, ...), ("--output", str, ...), ("--individuals", str, None), ("--region", str, None), ne, ("--cov-cutoff", float, 1e-7), ("--window-size", int, 5000), ("--n-bpoints", int, None), ("--n-snps-bw-bpoints", int, 10_000), ("--subset", str, "fourier_ls"), ("--full", bool, False), ("--force-covariance", bool, False), ("--delete-covariance-cache", bool, False))
    command("partition-chromosome", ("--genetic-map", str, ...), ("--chrom", str, ...), ("--n-individuals", int, ...), ("--output", str, ...), ("--window-size", int, 5000), ne, ("--cutoff", float, 1.5e-8))
    command("calc-covariance", ("--reference-panel", str, ...), ("--genetic-map", str, ...), ("--individuals", str, None), ("--region", str, None), ("--output", str, ...), ne, ("--cutoff", float, 1e-7), ("--full", bool, False), ("--compression", str, "zstd"))
    command("matrix-to-vector", ("--covariance", str, ...), ("--partitions", str, ...), ("--chrom", str, ...), ("--output", str, ...), first, last, ("--matrix-output", str, None))
    command("find-minima", ("--covariance", str, ...), ("--partitions", str, ...), ("--chrom", str, ...), ("--output", str, ...), ("--n-bpoints", int, None), ("--n-snps-bw-bpoints", int, 10_000), ("--subset", str, "fourier_ls"), ("--trackback-delta", int, 200), ("--trackback-step", int, 20), ("--init-search-location", int, 1000), first, last)
    command("extract-bpoints", ("--breakpoints", str, ...), ("--chrom", str, ...), ("--subset", str, "fourier_ls"), ("--partitions", str, ...), ("--output", str, ...))
    command("interpolate-maps", ("--snps", str, ...), ("--genetic-map", str, ...), ("--output", str, ...), ("--mode", str, "point"))
    command("covariance-summary", ("--covariance", str, ...), ("--partitions", str, ...), ("--chrom", str, ...), ("--output", str, ...), ("--format", str, "tsv"))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("linkblocks").getOrCreate()
    parts = lambda: text.read_partitions(spark, a.partitions, a.chrom)
    if a.command == "run":
        pipeline.run(spark, a.reference_panel, a.genetic_map, a.output, a.individuals, a.region, a.ne, a.cov_cutoff, a.window_size, a.n_bpoints, a.n_snps_bw_bpoints, a.subset, a.full, a.force_covariance, not a.delete_covariance_cache)
    elif a.command == "partition-chromosome":
        gmap = text.read_genetic_map(spark, a.genetic_map, a.chrom)
        sinks.write_partitions(maps.partition_chromosome(gmap, a.n_individuals, a.window_size, a.ne, a.cutoff), a.output, a.chrom)
    elif a.command == "calc-covariance":
        chosen = [r["sample"] for r in text.read_individuals(spark, a.individuals).orderBy("ord").collect()] if a.individuals else text.vcf_samples(spark, a.reference_panel)
        found = text.read_vcf(spark, a.reference_panel, chosen, a.region)
        gmap = text.map_of(found, text.read_genetic_map(spark, a.genetic_map))
        known = text.usable(found.join(gmap.select("chrom", "pos", F.col("cm").alias("g")), ["chrom", "pos"]))
        cov = covariance.covariance(covariance.prepare_panel(known), 2 * len(chosen), len(chosen), a.ne, a.cutoff, a.full)
        CovarianceStore(spark, a.output).write(cov.withColumn("p_index", F.lit(0)), a.compression)
    elif a.command == "matrix-to-vector":
        cov = CovarianceStore(spark, a.covariance).read()
        sinks.write_vector(vector.to_vector(cov, parts(), a.snp_first, a.snp_last), a.output, a.chrom)
        if a.matrix_output:
            covariance.correlation_matrix(cov, a.snp_first or 0, a.snp_last or 1 << 62).write.mode("overwrite").parquet(a.matrix_output)
    elif a.command == "find-minima":
        search = {"start": a.init_search_location, "delta": a.trackback_delta, "step": a.trackback_step}
        found = pipeline.find_breakpoints(CovarianceStore(spark, a.covariance).read(), parts(), a.n_bpoints, a.n_snps_bw_bpoints, tuple(a.subset.split(",")), search=search, first=a.snp_first, last=a.snp_last)
        sinks.write_breakpoints(sinks.breakpoints_json(found.sets, found.widths, found.metrics, list(pipeline.SUBSETS)), a.output)
    elif a.command == "extract-bpoints":
        body = "struct<subsets:map<string,struct<loci:array<bigint>>>>"
        loci = spark.read.text(a.breakpoints).select(F.explode(F.from_json("value", body)["subsets"][a.subset]["loci"]).alias("locus")).withColumn("chrom", F.lit(a.chrom))
        sinks.write_bed(intervals.blocks_of(loci, vector.default_range(parts())), a.output)
    elif a.command == "interpolate-maps":
        snps = text.read_snp_bed(spark, a.snps).withColumn("chrom", F.lit("1"))
        sinks.write_interpolated(maps.interpolate(snps, text.read_recombination_map(spark, a.genetic_map, "1"), a.mode), a.output)
    else:
        sinks.write_summary(diagnostics.covariance_summary(CovarianceStore(spark, a.covariance).read(), parts()), a.output, a.format)


if __name__ == "__main__":
    main()
