"""Writers. Text outputs are sorted and of one file a folder, as their readers expect a file in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_vector(vector: DataFrame, path: str, chrom: str, compression: str = "gzip") -> None:
    """pos TAB value of one chromosome, no header."""
    vector.filter(F.col("chrom") == chrom).select("pos", "value").orderBy("pos").coalesce(1).write.mode("overwrite").option("sep", "\t").option("compression", compression).csv(path)


def averaged_vector(sums: DataFrame, counts: DataFrame) -> DataFrame:
    """The vector divided by how many pairs made each value (chrom, pos, n)."""
    return sums.join(counts, ["chrom", "pos"]).select("chrom", "pos", (F.col("value") / F.nullif(F.col("n"), F.lit(0))).alias("value"))


def _lines(rows: DataFrame, header: str, line, path: str, compression: str | None, *order: str) -> None:
    spark = rows.sparkSession
    head = spark.createDataFrame([(header,)], "value string").select(F.lit(0).alias("k"), F.struct(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order]).alias("o"), "value")
    body = rows.select(F.lit(1).alias("k"), F.struct(*order).alias("o"), line.alias("value"))
    out = head.unionByName(body).orderBy("k", "o").select("value").coalesce(1).write.mode("overwrite")
    (out.option("compression", compression) if compression else out).text(path)


def write_bed(blocks: DataFrame, path: str, header: str = "#chr\tstart\tstop", compression: str | None = None) -> None:
    """Blocks of all chromosomes under one header, tab separated; gzip where asked for."""
    _lines(blocks, header, F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("stop").cast("string")), path, compression, "chrom", "start")


def write_block_bed(blocks: DataFrame, path: str, compression: str | None = None) -> None:
    write_bed(blocks, path, "chr\tstart\tstop", compression)


def write_interpolated(snps: DataFrame, path: str, compression: str = "gzip") -> None:
    """rs_id, position, cM, one blank between them, in the order of the SNP list."""
    rows = snps.orderBy("chrom", "row_no").select(F.concat_ws(" ", "rs_id", F.col("pos").cast("string"), F.col("cm").cast("string")).alias("value"))
    rows.coalesce(1).write.mode("overwrite").option("compression", compression).text(path)


def write_partitions(partitions: DataFrame, path: str, chrom: str) -> None:
    rows = partitions.filter(F.col("chrom") == chrom).orderBy("p_index").select(F.concat_ws(" ", F.col("start").cast("string"), F.col("end").cast("string")).alias("value"))
    rows.coalesce(1).write.mode("overwrite").text(path)


def breakpoints_json(sets: DataFrame, widths: DataFrame, metrics: DataFrame, all_subsets: list[str]) -> DataFrame:
    """chrom, value: one JSON object a chromosome. sets: chrom, subset, idx, locus; widths: chrom, n_bpoints, found_width; metrics: chrom, subset, sum, n_nonzero, n_zero, unrefined_count."""
    loci = sets.groupBy("chrom", "subset").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "locus"))), lambda s: s["locus"]).alias("loci"))
    each = loci.join(metrics, ["chrom", "subset"], "left")
    body = F.struct("loci", F.struct(F.col("sum").cast("string").alias("sum"), F.col("n_nonzero").alias("N_nonzero"), F.col("n_zero").cast("string").alias("N_zero")).alias("metric"), "unrefined_count")
    grouped = each.groupBy("chrom").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("subset", body.alias("b"))))).alias("subsets"), F.sort_array(F.collect_list("subset")).alias("computed_subsets"))
    skipped = F.array_except(F.array(*[F.lit(s) for s in all_subsets]), F.col("computed_subsets"))
    return grouped.join(widths, "chrom").select("chrom", F.to_json(F.struct("n_bpoints", "found_width", "computed_subsets", skipped.alias("skipped_subsets"), "subsets")).alias("value"))


def write_breakpoints(json: DataFrame, path: str) -> None:
    json.orderBy("chrom").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_summary(summary: DataFrame, path: str, kind: str = "tsv") -> None:
    one = summary.orderBy("chrom", "partition").coalesce(1).write.mode("overwrite")
    if kind == "json":
        one.json(path)
    else:
        one.option("sep", "\t").option("header", "true").csv(path)
