"""Readers of text inputs, plain or gzipped. Row order, where it matters, is kept in row_no."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, row_no, value of every line. A text input of one file is read in order; row_no counts up through it, with gaps between splits."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row_no"), "value")


def _fields(spark: SparkSession, path: str, pattern: str = r"\s+") -> DataFrame:
    return numbered_lines(spark, path).withColumn("f", F.split(F.trim("value"), pattern))


def _int(column: Column) -> Column:
    return F.when(column.rlike(r"^[+-]?\d+$"), column.try_cast("bigint"))


def read_individuals(spark: SparkSession, path: str) -> DataFrame:
    """sample, ord: the first token of each line that is not blank."""
    rows = _fields(spark, path).filter(F.trim("value") != "")
    order = Window.partitionBy("file").orderBy("row_no")
    return rows.select(F.get("f", F.lit(0)).alias("sample"), (F.row_number().over(order) - 1).alias("ord"))


def count_individuals(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).filter(F.trim("value") != "").count()


def bare(chrom: Column) -> Column:
    """A chromosome's name without 'chr'."""
    return F.regexp_replace(chrom, "^chr", "")


def read_genetic_map(spark: SparkSession, path: str, chrom: str | None = None) -> DataFrame:
    """chrom, row_no, pos, cm from columns 1, 2 and 3; of repeated positions the last counts. chrom: its rows alone (with or without 'chr'), under that name."""
    rows = _fields(spark, path).filter(F.size("f") >= 3).select(F.col("f")[0].alias("chrom"), "row_no", _int(F.col("f")[1]).alias("pos"), F.col("f")[2].try_cast("double").alias("cm")).dropna()
    if chrom is not None:
        rows = rows.filter(bare(F.col("chrom")) == bare(F.lit(chrom))).withColumn("chrom", F.lit(chrom))
    last = rows.groupBy("chrom", "pos").agg(F.max_by("cm", "row_no").alias("cm"), F.min("row_no").alias("row_no"))
    return last.select("chrom", "row_no", "pos", "cm")


def map_of(variants: DataFrame, gmap: DataFrame) -> DataFrame:
    """gmap under the variants' names of chromosomes (with or without 'chr'); chromosomes that the variants lack are left out."""
    names = variants.select("chrom").distinct().select(F.col("chrom").alias("_name"), bare(F.col("chrom")).alias("_bare"))
    return gmap.join(F.broadcast(names), bare(F.col("chrom")) == F.col("_bare")).withColumn("chrom", F.col("_name")).drop("_name", "_bare")  # one row a chromosome


def read_recombination_map(spark: SparkSession, path: str, chrom: str) -> DataFrame:
    """chrom, row_no, pos, rate, cum_cm; the header line is skipped."""
    rows = _fields(spark, path).select("row_no", _int(F.col("f")[0]).alias("pos"), F.get("f", F.lit(1)).try_cast("double").alias("rate"), F.get("f", F.lit(2)).try_cast("double").alias("cum_cm")).dropna()
    return rows.select(F.lit(chrom).alias("chrom"), "row_no", "pos", "rate", "cum_cm")


def _bed_fields(spark: SparkSession, path: str, least: int) -> DataFrame:
    rows = _fields(spark, path).filter(~F.col("value").rlike(r"^\s*(#|track\b|browser\b|$)") & (F.size("f") >= least))
    return rows.withColumn("a", _int(F.get("f", F.lit(1)))).withColumn("b", _int(F.get("f", F.lit(2))))


def read_snp_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, row_no, pos (the end column), rs_id of lines with four columns and an integer end."""
    return _bed_fields(spark, path, 4).filter("b is not null").select(F.col("f")[0].alias("chrom"), "row_no", F.col("b").alias("pos"), F.col("f")[3].alias("rs_id"))


def read_blocks(spark: SparkSession, path: str, single: bool = False) -> DataFrame:
    """chrom, row_no, start, stop of a BED file; single: of its first chromosome only. Headers and rows without integers are skipped."""
    rows = _bed_fields(spark, path, 3).filter("a is not null and b is not null").select(F.col("f")[0].alias("chrom"), "row_no", F.col("a").alias("start"), F.col("b").alias("stop"))
    if single:
        first = rows.agg(F.min_by("chrom", "row_no").alias("chrom"))
        rows = rows.join(F.broadcast(first), "chrom")  # one row
    return rows


def read_partitions(spark: SparkSession, path: str, chrom: str) -> DataFrame:
    """chrom, p_index, start, end of a list of 'start end' lines."""
    rows = _fields(spark, path).select("file", "row_no", _int(F.col("f")[0]).alias("start"), _int(F.get("f", F.lit(1))).alias("end")).dropna()
    order = Window.partitionBy("file").orderBy("row_no")
    return rows.select(F.lit(chrom).alias("chrom"), (F.row_number().over(order) - 1).alias("p_index"), "start", "end")


def read_vector(spark: SparkSession, path: str, chrom: str) -> DataFrame:
    rows = _fields(spark, path).select(_int(F.col("f")[0]).alias("pos"), F.get("f", F.lit(1)).try_cast("double").alias("value")).dropna()
    return rows.select(F.lit(chrom).alias("chrom"), "pos", "value")


def read_centromeres(spark: SparkSession, path: str, chrom: str | None = None, merge_arms: bool = False) -> DataFrame:
    """chrom, start, stop from a BED file or a table with a leading bin column; merge_arms: one interval a chromosome."""
    rows = _fields(spark, path).filter(~F.col("value").startswith("#"))
    binned = F.col("f")[0].rlike(r"^\d+$") & _int(F.get("f", F.lit(2))).isNotNull() & _int(F.get("f", F.lit(3))).isNotNull()
    at = F.when(binned, 1).otherwise(0)
    out = rows.select(F.get("f", at).alias("chrom"), _int(F.get("f", at + 1)).alias("start"), _int(F.get("f", at + 2)).alias("stop")).dropna()
    if chrom is not None:
        out = out.filter(bare(F.col("chrom")) == bare(F.lit(chrom)))
    return out.groupBy("chrom").agg(F.min("start").alias("start"), F.max("stop").alias("stop")) if merge_arms else out


def read_population_panel(spark: SparkSession, path: str, populations: list[str], present: DataFrame | None = None) -> DataFrame:
    """sample, population of the wanted populations (columns: sample, population, ...), kept to the samples of `present`."""
    rows = _fields(spark, path).filter(F.size("f") >= 2).select(F.col("f")[0].alias("sample"), F.col("f")[1].alias("population")).filter(F.col("population").isin(populations))
    return rows if present is None else rows.join(present.select("sample").distinct(), "sample", "left_semi")


def read_table(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """A white-space separated table with a header line (or the given names), all columns strings."""
    if names is None:
        head = spark.read.text(path).first()
        names = re.split(r"\s+", (head[0] if head else "").strip().lstrip("#"))
    rows = _fields(spark, path).filter((F.trim("value") != "") & (F.regexp_replace(F.array_join("f", " "), r"^#", "") != F.lit(" ".join(names))))
    out = rows.select("row_no", *[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return out.filter(F.col(f"`{names[0]}`") != names[0])


def parse_region(region: str) -> tuple[str, int | None, int | None]:
    """'chrom' or 'chrom:start-end', 1-based with both ends included."""
    m = re.fullmatch(r"([^:]+)(?::(\d+)-(\d+))?", region)
    if not m:
        raise ValueError(f"not a region: {region!r}")
    return m[1], int(m[2]) if m[2] else None, int(m[3]) if m[3] else None


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    head = spark.read.text(path).filter(F.col("value").startswith("#CHROM")).first()
    if head is None:
        raise ValueError(f"{path} has no #CHROM line")
    return head[0].split("\t")[9:]


def read_vcf(spark: SparkSession, path: str, individuals: list[str] | None = None, region: str | None = None, gmap: DataFrame | None = None) -> DataFrame:
    """chrom, pos, rs_id, haps (0/1, two a sample, in the order asked for), record_no, and g where a map (chrom, pos, cm) is given.

    Records outside the region or the map are dropped, and those where any
    chosen sample is unphased or missing. Unknown samples raise ValueError
    naming all. Text input, plain or gzipped; for repeated use write the result
    as Parquet sorted by position once.
    """
    names = vcf_samples(spark, path)
    chosen = list(individuals) if individuals is not None else names
    unknown = [s for s in chosen if s not in names]
    if unknown:
        raise ValueError(f"not in the file: {', '.join(unknown)}")
    at = [names.index(s) + 9 for s in chosen]
    rows = numbered_lines(spark, path).filter(~F.col("value").startswith("#")).withColumn("f", F.split("value", "\t")).filter(F.size("f") >= 9)
    rows = rows.select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("bigint").alias("pos"), F.col("f")[2].alias("rs_id"), F.col("row_no").alias("record_no"), F.col("f")[3].alias("ref"), F.col("f")[4].alias("alt"), F.transform(F.array(*[F.lit(i) for i in at]), lambda i: F.element_at(F.split(F.get("f", i), ":"), 1)).alias("gt"))
    if region is not None:
        name, start, end = parse_region(region)
        rows = rows.filter(F.col("chrom") == name)
        if start is not None:
            rows = rows.filter(F.col("pos").between(start, end))
    if gmap is not None:
        rows = rows.join(gmap.select("chrom", "pos", F.col("cm").alias("g")), ["chrom", "pos"])
    phased = rows.withColumn("phased", F.forall("gt", lambda g: g.rlike(r"^\d+\|\d+$")))
    haps = F.flatten(F.transform("gt", lambda g: F.transform(F.split(g, r"\|"), lambda a: F.when(a == "0", 0).otherwise(1).cast("tinyint"))))
    keep = ["chrom", "pos", "rs_id", "record_no", "ref", "alt", *(["g"] if gmap is not None else [])]
    return phased.select(*keep, F.when(F.col("phased"), haps).alias("haps"), "phased")


def usable(variants: DataFrame) -> DataFrame:
    """Phased records without missing calls; the first record of a position."""
    first = Window.partitionBy("chrom", "pos").orderBy("record_no")
    return variants.filter("phased").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "phased")


def skip_counts(variants: DataFrame) -> DataFrame:
    """chrom, records, unphased, duplicates: what usable() leaves out, for a warning."""
    kept = F.count_distinct(F.when(F.col("phased"), F.col("pos")))
    return variants.groupBy("chrom").agg(F.count(F.lit(1)).alias("records"), F.count_if(~F.col("phased")).alias("unphased"), (F.count_if(F.col("phased")) - kept).alias("duplicates"))


def filter_variants(variants: DataFrame, min_af: float = 0.01, minor: bool = False, min_mac: int = 1) -> DataFrame:
    """Biallelic single-nucleotide variants with enough copies of the alternative (or minor) allele."""
    n, k = F.size("haps"), F.aggregate("haps", F.lit(0), lambda acc, x: acc + x)
    mac = F.least(k, n - k)
    frequency = (mac if minor else k) / n
    return variants.filter((F.length("ref") == 1) & F.col("alt").rlike("^[ACGTacgt]$") & (frequency >= min_af) & (mac >= min_mac))


def allele_histogram(variants: DataFrame) -> DataFrame:
    """chrom, mac, n: how many records have each minor allele count."""
    n, k = F.size("haps"), F.aggregate("haps", F.lit(0), lambda acc, x: acc + x)
    return variants.withColumn("mac", F.least(k, n - k)).groupBy("chrom", "mac").agg(F.count(F.lit(1)).alias("n"))
