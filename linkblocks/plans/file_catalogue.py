"""Sources, sinks and commands as queries: each writes files derived from the general tables to the shared folder and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..operators import covariance, maps
from ..sources import sinks, text
from ..sources.store import CovarianceStore
from . import fixtures as fx
from .catalogue import _WINDOWS, _breakpoints, _r, _vector, query
from .scratch import folder

#: Samples of the text panel; each has two haplotypes of the vectors.
SAMPLES = 4


def _path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def _lines(rows: DataFrame, value: Column, *order, head: tuple[str, ...] = ()) -> str:
    """Path of a text of one line a row, in order, after the head lines."""
    spark = rows.sparkSession
    path = _path(spark, "lines")
    body = rows.select(F.lit(1).alias("k"), F.struct(*order).alias("o"), value.alias("value"))
    first = spark.createDataFrame([(i, h) for i, h in enumerate(head)], "i int, value string").select(F.lit(0).alias("k"), F.lit(None).cast(body.schema["o"].dataType).alias("o"), "value", "i")
    whole = first.unionByName(body.withColumn("i", F.lit(0))).orderBy("k", "i", "o")
    whole.select("value").coalesce(1).write.text(path)
    return path


# ---- the text panel: three chromosomes, repeated positions, unphased and missing calls


def _vcf(s, d) -> str:
    v = F.col("vec_id")
    bit = lambda k: (F.col("embedding")[k] > 0).cast("int").cast("string")
    call = lambda k: F.concat(bit(2 * k), F.when((v % 17 == 0) & F.lit(k == 1), "/").otherwise("|"), F.when((v % 19 == 0) & F.lit(k == 2), ".").otherwise(bit(2 * k + 1)))
    value = F.concat_ws("\t", F.concat(F.lit("c"), (v % 3).cast("string")), (1000 + 100 * F.floor(v / 6)).cast("string"), F.concat(F.lit("rs"), v.cast("string")), F.lit("A"), F.when(v % 5 == 0, "CT").otherwise("C"), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), *[call(k) for k in range(SAMPLES)])
    return _lines(fx.table(s, d, "embeddings"), value, "vec_id", head=("##fileformat=VCFv4.2", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *[f"s{k}" for k in range(SAMPLES)]])))


_RECORDS = "records AS MATERIALIZED (SELECT vec_id AS v, 'c' || (vec_id % 3) AS chrom, 1000 + 100 * (vec_id // 6) AS pos, 'rs' || vec_id AS rs_id, list_transform(embedding[1:8], lambda x: (x > 0)::INT) AS h, vec_id % 17 = 0 AS s1, vec_id % 19 = 0 AS s2 FROM embeddings)"


@query("src_01_samples_in_order", "SELECT chrom, pos, arg_min(rs_id, v) AS rs_id, arg_min(h[5]::VARCHAR || h[6] || h[1] || h[2], v) AS haps FROM records WHERE NOT s2 GROUP BY chrom, pos", _RECORDS)
def src_01(s, d):
    return text.usable(text.read_vcf(s, _vcf(s, d), ["s2", "s0"])).select("chrom", "pos", "rs_id", F.array_join(F.transform("haps", lambda h: h.cast("string")), "").alias("haps"))


@query("src_01_region", "SELECT chrom, pos, rs_id, NOT (s1 OR s2) AS phased FROM records WHERE chrom = 'c1' AND pos BETWEEN 1500 AND 3000", _RECORDS)
def src_01_region(s, d):
    return text.read_vcf(s, _vcf(s, d), region="c1:1500-3000").select("chrom", "pos", "rs_id", "phased")


@query("src_03_phased_only", "SELECT chrom, pos, arg_min(rs_id, v) AS rs_id FROM records WHERE NOT s1 AND NOT s2 GROUP BY chrom, pos", _RECORDS)
def src_03(s, d):
    return text.usable(text.read_vcf(s, _vcf(s, d))).select("chrom", "pos", "rs_id")


@query("src_05_skip_counts", "SELECT chrom, count(*) AS records, count(*) FILTER (s1 OR s2) AS unphased, count(*) FILTER (NOT s1 AND NOT s2) - count(DISTINCT pos) FILTER (NOT s1 AND NOT s2) AS duplicates FROM records GROUP BY chrom", _RECORDS)
def src_05(s, d):
    return text.skip_counts(text.read_vcf(s, _vcf(s, d)))


@query("sca_24_filter_variants", "SELECT chrom, pos, rs_id FROM (SELECT chrom, pos, arg_min(rs_id, v) AS rs_id, arg_min(list_sum(h), v) AS k, min(v) AS v FROM records WHERE NOT s1 AND NOT s2 GROUP BY chrom, pos) WHERE v % 5 <> 0 AND k / 8 >= 0.3 AND least(k, 8 - k) >= 2", _RECORDS)
def sca_24(s, d):
    return text.filter_variants(text.usable(text.read_vcf(s, _vcf(s, d))), min_af=0.3, min_mac=2).select("chrom", "pos", "rs_id")


# ---- lists, maps, BED


def _individuals(s, d) -> str:
    return _lines(fx.table(s, d, "supplier"), F.when(F.col("s_suppkey") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("s_name"), F.lit("\tmore"))), "s_suppkey")


@query("src_06_individuals", "SELECT s_name AS sample, row_number() OVER (ORDER BY s_suppkey) - 1 AS ord FROM supplier WHERE s_suppkey % 4 <> 0")
def src_06(s, d):
    return text.read_individuals(s, _individuals(s, d)).select("sample", F.col("ord").cast("bigint").alias("ord"))


@query("src_07_individual_count", "SELECT count(*) AS n FROM supplier WHERE s_suppkey % 4 <> 0")
def src_07(s, d):
    return s.createDataFrame([(text.count_individuals(s, _individuals(s, d)),)], "n bigint")


def _map_file(s, d) -> str:
    return _lines(fx.records(s, d), F.concat_ws(" ", F.concat(F.lit("chr"), F.substring("chrom", 2, 9)), F.col("pos").cast("string"), F.col("value").cast("double").cast("string")), "record_no", head=("too short", "chr1 x 0.5"))


@query("src_08_genetic_map", "SELECT 'chr' || substr(chrom, 2) AS chrom, pos, arg_max(value, record_no)::DOUBLE AS cm FROM rec GROUP BY ALL")
def src_08(s, d):
    return text.read_genetic_map(s, _map_file(s, d)).select("chrom", "pos", "cm")


@query("src_08_one_chromosome", "SELECT '7' AS chrom, pos, arg_max(value, record_no)::DOUBLE AS cm FROM rec WHERE chrom = 'c7' GROUP BY pos")
def src_08_one(s, d):
    return text.read_genetic_map(s, _map_file(s, d), "7").select("chrom", "pos", "cm")


@query("src_09_recombination_map", "SELECT chrom, pos, round(rate, 9) AS rate, round(cum_cm, 9) AS cum_cm FROM rmap")
def src_09(s, d):
    path = _lines(fx.map_rows(s, d), F.concat_ws(" ", F.col("pos").cast("string"), F.col("rate").cast("string"), F.col("cum_cm").cast("string")), "pos", head=("position rate_cM_Mb genetic_position_cM",))
    return text.read_recombination_map(s, path, "m1").select("chrom", "pos", _r("rate"), _r("cum_cm"))


@query("src_10_snp_bed", "SELECT 'chr1' AS chrom, o_orderkey AS pos, 'rs' || o_custkey AS rs_id FROM orders WHERE o_orderkey % 3 <> 0")
def src_10(s, d):
    k = F.col("o_orderkey").cast("string")
    line = F.when(F.col("o_orderkey") % 6 == 0, F.concat_ws("\t", F.lit("chr1"), k, F.lit("x1"), F.lit("bad"))).when(F.col("o_orderkey") % 3 == 0, F.concat_ws("\t", F.lit("chr1"), k, k))
    line = line.otherwise(F.concat_ws("\t", F.lit("chr1"), (F.col("o_orderkey") - 1).cast("string"), k, F.concat(F.lit("rs"), F.col("o_custkey").cast("string"))))
    return text.read_snp_bed(s, _lines(fx.table(s, d, "orders"), line, "o_orderkey", head=("track name=x a b", "browser position y z", "", "# c o m"))).select("chrom", "pos", "rs_id")


@query("src_11_partitions", 'SELECT chrom, p_index, "start", "end" FROM parts')
def src_11(s, d):
    sinks.write_partitions(fx.partitions(s, d), path := _path(s, "partitions"), "c1")
    return text.read_partitions(s, path, "c1").select("chrom", F.col("p_index").cast("int").alias("p_index"), "start", "end")


@query("src_12_vector", "SELECT chrom, pos, round(value, 6) AS value FROM vec")
def src_12(s, d):
    sinks.write_vector(_vector(s, d), path := _path(s, "vector"), "c1")
    return text.read_vector(s, path, "c1").select("chrom", "pos", _r("value", 6))


@query("snk_07_averaged_vector", "SELECT chrom, pos, round(value / (1 + pos % 4), 6) AS value FROM vec WHERE pos % 9 > 0")
def snk_07(s, d):
    v = _vector(s, d)
    sinks.write_vector(sinks.averaged_vector(v, v.filter("pos % 9 > 0").select("chrom", "pos", (1 + F.col("pos") % 4).alias("n"))), path := _path(s, "vector"), "c1", compression="none")
    return text.read_vector(s, path, "c1").select("chrom", "pos", _r("value", 6))


@query("src_13_genome_bed", 'SELECT chrom, "start", stop FROM ba')
def src_13(s, d):
    sinks.write_bed(fx.blocks_a(s, d), path := _path(s, "bed"))
    return text.read_blocks(s, path).select("chrom", "start", "stop")


@query("src_14_first_chromosome", 'SELECT chrom, "start", stop FROM ba WHERE chrom = (SELECT min(chrom) FROM ba)')
def src_14(s, d):
    sinks.write_bed(fx.blocks_a(s, d), path := _path(s, "bed"))
    return text.read_blocks(s, path, single=True).select("chrom", "start", "stop")


@query("snk_10_gzipped_blocks", 'SELECT chrom, "start", stop FROM bb')
def snk_10(s, d):
    sinks.write_block_bed(fx.blocks_b(s, d), path := _path(s, "bed"), compression="gzip")
    return text.read_blocks(s, path).select("chrom", "start", "stop")


@query("snk_13_combined_beds", """SELECT chrom, row_number() OVER (ORDER BY chrom, "start", stop) AS place, "start", stop FROM (SELECT * FROM ba UNION ALL SELECT * FROM bb)""")
def snk_13(s, d):
    sinks.write_bed(fx.blocks_a(s, d).unionByName(fx.blocks_b(s, d)), path := _path(s, "bed"))
    from pyspark.sql import Window

    return text.read_blocks(s, path).select("chrom", F.row_number().over(Window.orderBy("chrom", "start", "stop")).cast("bigint").alias("place"), "start", "stop")


@query("snk_11_interpolated_map", "SELECT rs_id, pos, round(pos * 1e-6::DOUBLE, 9) AS cm FROM snps")
def snk_11(s, d):
    sinks.write_interpolated(fx.snps(s, d).withColumn("cm", F.col("pos") * F.lit(1e-6)), path := _path(s, "map"))
    f = F.split("value", " ")
    return s.read.text(path).select(f[0].alias("rs_id"), f[1].cast("bigint").alias("pos"), F.round(f[2].cast("double"), 9).alias("cm"))


@query("src_26_centromeres", 'SELECT chrom, min("start") AS "start", max(stop) AS stop FROM ba GROUP BY chrom')
def src_26(s, d):
    path = _lines(fx.blocks_a(s, d), F.concat_ws("\t", F.lit("585"), "chrom", F.col("start").cast("string"), F.col("stop").cast("string"), F.lit("acen")), "chrom", "start", head=("#bin\tchrom\tchromStart\tchromEnd\tname",))
    return text.read_centromeres(s, path, merge_arms=True)


@query("src_26_centromere_bed", "SELECT chrom, \"start\", stop FROM bb WHERE chrom = 'chr3'")
def src_26_bed(s, d):
    path = _lines(fx.blocks_b(s, d), F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("stop").cast("string")), "chrom", "start")
    return text.read_centromeres(s, path, "3")


@query("src_27_population_panel", "SELECT 's' || c_custkey AS sample, 'p' || c_nationkey AS population FROM customer WHERE c_nationkey IN (1, 7) AND c_custkey % 2 = 0")
def src_27(s, d):
    c = fx.table(s, d, "customer")
    path = _lines(c, F.concat_ws("\t", F.concat(F.lit("s"), F.col("c_custkey").cast("string")), F.concat(F.lit("p"), F.col("c_nationkey").cast("string")), F.lit("ALL")), "c_custkey", head=("sample\tpop\tsuper_pop",))
    return text.read_population_panel(s, path, ["p1", "p7"], c.filter("c_custkey % 2 = 0").select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("sample")))


@query("src_28_decode_rows", "SELECT chrom, row_number() OVER (ORDER BY pos) - 1 AS row_no, pos, round(rate, 9) AS rate, round(cum_cm, 9) AS cum_cm FROM rmap")
def src_28(s, d):
    raw = fx.map_rows(s, d).select("chrom", F.col("pos").alias("begin"), (F.col("pos") + 1000).alias("end"), "rate", F.col("cum_cm").alias("cm"))
    return maps.decode_rows(raw).select("chrom", "row_no", "pos", _r("rate"), _r("cum_cm"))


@query("src_28_pyrho_rows", "SELECT chrom, row_number() OVER (ORDER BY pos) - 1 AS row_no, pos, round(rate, 9) AS rate, round(cum_cm, 9) AS cum_cm FROM rmap")
def src_28_pyrho(s, d):
    rows = fx.map_rows(s, d)
    path = _lines(rows, F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.col("rate").cast("string"), F.col("cum_cm").cast("string")), "pos", head=("#Chromosome\tPosition(bp)\tRate(cM/Mb)\tMap(cM)",))
    return maps.pyrho_rows(text.read_table(s, path).drop("row_no")).select("chrom", "row_no", "pos", _r("rate"), _r("cum_cm"))


# ---- the store


def _store(s, d, compression: str = "zstd") -> CovarianceStore:
    store = CovarianceStore(s, _path(s, "store"))
    store.write(fx.partitioned_cov(s, d), compression)
    return store


_STORED = "SELECT chrom, p_index, lo, hi, round(s, 9) AS shrink_ld FROM pcov"


@query("snk_01_store", _STORED)
def snk_01(s, d):
    return _store(s, d).read().select("chrom", "p_index", "lo", "hi", _r("shrink_ld"))


@query("snk_03_store_in_parts", _STORED)
def snk_03(s, d):
    store, rows = CovarianceStore(s, _path(s, "store")), fx.partitioned_cov(s, d)
    for part in ("p_index % 2 = 0", "p_index % 2 = 1"):
        store.write(rows.filter(part))
    return store.read().select("chrom", "p_index", "lo", "hi", _r("shrink_ld"))


@query("snk_04_gzipped_store", _STORED)
def snk_04(s, d):
    return _store(s, d, "gzip").read().select("chrom", "p_index", "lo", "hi", _r("shrink_ld"))


@query("src_16_store_diagonal", _STORED + " WHERE lo = hi")
def src_16(s, d):
    return _store(s, d).diagonal().select("chrom", "p_index", "lo", "hi", _r("shrink_ld"))


@query("src_17_store_loci", "SELECT DISTINCT chrom, p_index, lo AS pos FROM pcov")
def src_17(s, d):
    return _store(s, d).loci()


@query("src_18_store_range", _STORED + " WHERE lo BETWEEN 9000 AND 14000")
def src_18(s, d):
    return _store(s, d).lo_range("c1", 9000, 14000).select("chrom", "p_index", "lo", "hi", _r("shrink_ld"))


@query("src_19_store_owned", "SELECT chrom, p_index, lo, hi, round(s, 9) AS shrink_ld FROM own")
def src_19(s, d):
    return _store(s, d).owned(fx.partitions(s, d)).select("chrom", "p_index", "lo", "hi", _r("shrink_ld"))


@query("src_20_store_counts", "SELECT chrom, p_index, count(*) AS rows FROM pcov GROUP BY ALL")
def src_20(s, d):
    return _store(s, d).row_counts()


@query("src_21_store_present", "SELECT DISTINCT chrom, p_index FROM pcov")
def src_21(s, d):
    store = _store(s, d)
    store.validate(store.read())
    return s.createDataFrame(sorted(store.present()), "chrom string, p_index int")


@query("snk_06_store_index", 'SELECT chrom, p_index, lo, n, (sum(n) OVER (PARTITION BY chrom, p_index ORDER BY lo) - n)::BIGINT AS "offset" FROM (SELECT chrom, p_index, lo, count(*) AS n FROM pcov GROUP BY ALL)')
def snk_06(s, d):
    return _store(s, d).lo_index()


@query("snk_12_deleted_store", "SELECT 0::BIGINT AS partitions")
def snk_12(s, d):
    store = _store(s, d)
    store.delete()
    return s.createDataFrame([(len(store.present()),)], "partitions bigint")


# ---- breakpoints and commands


def _breakpoint_file(s, d) -> str:
    sets = _breakpoints(s, d).withColumn("subset", F.lit("fourier"))
    n = sets.groupBy("chrom").agg(F.count(F.lit(1)).cast("int").alias("n_bpoints")).withColumn("found_width", F.lit(10))
    metrics = sets.select("chrom", "subset").distinct().withColumns({"sum": F.lit(0.5), "n_nonzero": F.lit(3).cast("bigint"), "n_zero": F.lit(7.0), "unrefined_count": F.lit(None).cast("bigint")})
    sinks.write_breakpoints(sinks.breakpoints_json(sets, n, metrics, ["fourier", "uniform"]), path := _path(s, "breakpoints"))
    return path


@query("snk_08_breakpoint_json", "SELECT idx, locus, 'fourier' AS computed, 'uniform' AS skipped, 10 AS found_width FROM bp")
def snk_08(s, d):
    body = "struct<found_width:int,computed_subsets:array<string>,skipped_subsets:array<string>,subsets:map<string,struct<loci:array<bigint>>>>"
    read = s.read.text(_breakpoint_file(s, d)).select(F.from_json("value", body).alias("b"))
    return read.select(F.posexplode(F.col("b.subsets")["fourier"]["loci"]).alias("idx", "locus"), F.array_join("b.computed_subsets", ",").alias("computed"), F.array_join("b.skipped_subsets", ",").alias("skipped"), "b.found_width").withColumn("idx", F.col("idx").cast("bigint"))


def _gmap_file(s, d) -> str:
    return _lines(fx.gmap(s, d), F.concat_ws(" ", "chrom", F.col("pos").cast("string"), F.col("cm").cast("string")), "pos")


def _partition_file(s, d) -> str:
    sinks.write_partitions(fx.partitions(s, d), path := _path(s, "partitions"), "c1")
    return path


@query("cli_partition_chromosome", 'SELECT chrom, p_index, "start", "end" FROM parts')
def cli_partition(s, d):
    cli.main(["partition-chromosome", "--genetic-map", _gmap_file(s, d), "--chrom", "c1", "--n-individuals", str(fx.N_INDIVIDUALS), "--window-size", str(fx.WINDOW), "--output", out := _path(s, "out")], s)
    return text.read_partitions(s, out, "c1").select("chrom", F.col("p_index").cast("int").alias("p_index"), "start", "end")


@query("cli_calc_covariance", "SELECT chrom, lo, hi, round(s, 9) AS shrink_ld FROM cov")
def cli_covariance(s, d):
    v = fx.variants(s, d)
    calls = F.transform(F.sequence(F.lit(0), F.lit(fx.N_HAPLOTYPES // 2 - 1)), lambda k: F.concat(F.get("haps", 2 * k).cast("string"), F.lit("|"), F.get("haps", 2 * k + 1).cast("string")))
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "rs_id", F.lit("A"), F.lit("C"), F.lit("."), F.lit("."), F.lit("."), F.lit("GT"), F.array_join(calls, "\t"))
    vcf = _lines(v, line, "pos", head=("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *[f"s{i}" for i in range(fx.N_HAPLOTYPES // 2)]]),))
    cli.main(["calc-covariance", "--reference-panel", vcf, "--genetic-map", _gmap_file(s, d), "--cutoff", str(fx.CUTOFF), "--output", out := _path(s, "out")], s)
    return CovarianceStore(s, out).read().select("chrom", "lo", "hi", _r("shrink_ld"))


@query("cli_matrix_to_vector", "SELECT chrom, pos, round(value, 6) AS value FROM vec")
def cli_vector(s, d):
    cli.main(["matrix-to-vector", "--covariance", _store(s, d).root, "--partitions", _partition_file(s, d), "--chrom", "c1", "--output", out := _path(s, "out")], s)
    return text.read_vector(s, out, "c1").select("chrom", "pos", _r("value", 6))


@query("cli_extract_bpoints", 'SELECT chrom, pos AS "start", nx AS stop FROM (SELECT chrom, pos, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS nx FROM (SELECT chrom, locus AS pos FROM bp UNION ALL SELECT chrom, a FROM lim UNION ALL SELECT chrom, z + 1 FROM lim)) WHERE nx IS NOT NULL', _WINDOWS)
def cli_blocks(s, d):
    cli.main(["extract-bpoints", "--breakpoints", _breakpoint_file(s, d), "--chrom", "c1", "--subset", "fourier", "--partitions", _partition_file(s, d), "--output", out := _path(s, "out")], s)
    return text.read_blocks(s, out).select("chrom", "start", "stop")


@query("cli_interpolate_maps", "SELECT 'rs' || vec_id AS rs_id, 1000 + 100 * vec_id AS pos, round(0.01::DOUBLE * vec_id, 9) AS cm FROM embeddings")
def cli_interpolate(s, d):
    e = fx.table(s, d, "embeddings")
    at = (1000 + 100 * F.col("vec_id")).cast("string")
    snps = _lines(e, F.concat_ws("\t", F.lit("chr1"), at, at, F.concat(F.lit("rs"), F.col("vec_id").cast("string"))), "vec_id")
    gmap = _lines(e, F.concat_ws(" ", at, F.lit("1.0"), (F.lit(0.01) * F.col("vec_id")).cast("string")), "vec_id", head=("position rate cM",))
    cli.main(["interpolate-maps", "--snps", snps, "--genetic-map", gmap, "--output", out := _path(s, "out")], s)
    f = F.split("value", " ")
    return s.read.text(out).select(f[0].alias("rs_id"), f[1].cast("bigint").alias("pos"), F.round(f[2].cast("double"), 9).alias("cm"))


# ---- chromosomes are kept apart: a second one, a mirror of the first one's names


@query("rel_01_two_chromosomes", "SELECT c.chrom, lo, hi, round(s, 9) AS shrink_ld FROM cov JOIN (VALUES ('c1'), ('d2')) c(chrom) ON true")
def rel_01_two(s, d):
    v = fx.variants(s, d)
    panel = covariance.prepare_panel(v.unionByName(v.withColumn("chrom", F.lit("d2"))))
    return covariance.covariance(panel, fx.N_HAPLOTYPES, fx.N_INDIVIDUALS, cutoff=fx.CUTOFF).select("chrom", "lo", "hi", _r("shrink_ld"))


@query("win_01_two_chromosomes", 'SELECT c.chrom, p_index, lo, hi, round(s, 9) AS shrink_ld FROM pcov JOIN (VALUES (\'c1\'), (\'d2\')) c(chrom) ON true')
def win_01_two(s, d):
    both = lambda df: df.unionByName(df.withColumn("chrom", F.lit("d2")))
    parts = maps.partition_chromosome(both(fx.gmap(s, d)), fx.N_INDIVIDUALS, window=fx.WINDOW)
    return covariance.by_partition(both(fx.cov(s, d)), parts).select("chrom", "p_index", "lo", "hi", _r("shrink_ld"))
