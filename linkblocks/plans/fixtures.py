"""Panels, maps and block sets derived from general tables, so that every operator can be run (and held against SQL) on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import covariance, maps
from .scratch import stage

N_INDIVIDUALS, N_HAPLOTYPES, CUTOFF, WINDOW = 32, 64, 1e-7, 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phased panel: a position for each vector, a haplotype for the sign of each of its 64 numbers."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.lit("c1").alias("chrom"),
        (1000 + 100 * v + (v * 7) % 13).alias("pos"),
        F.concat(F.lit("rs"), v.cast("string")).alias("rs_id"),
        v.alias("record_no"),
        (F.lit(0.0004) * v + F.lit(0.02) * F.floor(v / 40)).alias("g"),
        F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0).cast("tinyint")).alias("haps"),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covariance.prepare_panel(variants(spark, sf_dir))


def cov(spark: SparkSession, sf_dir: str, cutoff: float = CUTOFF) -> DataFrame:
    return covariance.covariance(panel(spark, sf_dir), N_HAPLOTYPES, N_INDIVIDUALS, cutoff=cutoff)


def gmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir).select("chrom", F.col("record_no").alias("row_no"), "pos", F.col("g").alias("cm"))


def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "partitions", lambda: maps.partition_chromosome(gmap(spark, sf_dir), N_INDIVIDUALS, window=WINDOW))


def partitioned_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The covariance store: made once, as later stages read it from disk."""
    return stage(spark, sf_dir, "covariance", lambda: covariance.by_partition(cov(spark, sf_dir), partitions(spark, sf_dir)))


def map_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recombination map from part: a row each 1000 positions."""
    rate = F.col("p_retailprice") / 1000.0
    along = Window.partitionBy("chrom").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "part").select(F.lit("m1").alias("chrom"), "p_partkey", F.col("p_partkey").alias("row_no"), (F.col("p_partkey") * 1000).alias("pos"), rate.alias("rate"))
    return rows.withColumn("cum_cm", F.sum(F.col("rate") * F.lit(0.001)).over(along)).drop("p_partkey")


def snps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions from orders, spread over the map and somewhat beyond both ends."""
    n = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "orders").join(F.broadcast(n))  # one row
    rows = rows.select(F.lit("m1").alias("chrom"), (F.col("o_orderkey") * 7919 % (F.col("n") * 1000 + 3000)).alias("pos"), F.concat(F.lit("rs"), F.col("o_orderkey").cast("string")).alias("rs_id"))
    return rows.withColumn("row_no", F.row_number().over(Window.partitionBy("chrom").orderBy("pos", "rs_id")).cast("bigint"))


def _blocks(points: DataFrame) -> DataFrame:
    along = Window.partitionBy("chrom").orderBy("pos")
    return points.withColumn("stop", F.lead("pos").over(along)).filter("stop is not null").select("chrom", F.col("pos").alias("start"), "stop")


def blocks_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return _blocks(table(spark, sf_dir, "customer").select(F.concat(F.lit("chr"), F.col("c_nationkey").cast("string")).alias("chrom"), (k * 1000 + k * 37 % 501).alias("pos")))


def blocks_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _blocks(table(spark, sf_dir, "supplier").select(F.concat(F.lit("chr"), F.col("s_nationkey").cast("string")).alias("chrom"), (k * 15000 + k * 53 % 777).alias("pos")))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping intervals in time: from each event as many seconds as its value says."""
    e = table(spark, sf_dir, "events")
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint")
    return e.select(F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("chrom"), start.alias("start"), (start + F.floor(F.abs("value") * 60.0) + 1).alias("stop"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated positions with values: lineitem by part."""
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("chrom"), F.col("l_partkey").alias("pos"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_no"), F.col("l_extendedprice").alias("value"), F.col("l_linenumber").cast("bigint").alias("line"))


_THETA = scalar.watterson_theta(N_HAPLOTYPES)
#: The same in DuckDB's SQL, as common table expressions.
SQL = f"""
panel AS MATERIALIZED (SELECT 'c1' AS chrom, vec_id AS i, 1000 + 100 * vec_id + (vec_id * 7) % 13 AS pos, 0.0004::DOUBLE * vec_id + 0.02::DOUBLE * floor(vec_id / 40) AS g, list_transform(embedding, lambda x: (x > 0)::INT) AS h FROM embeddings),
ones AS MATERIALIZED (SELECT *, list_sum(h)::BIGINT AS n1 FROM panel),
near AS MATERIALIZED (
  SELECT a.chrom, a.i AS ia, b.i AS ib, a.pos AS lo, b.pos AS hi, a.g AS ga, b.g AS gb, a.n1 AS n1a, b.n1 AS n1b,
         list_sum(list_transform(range(1, 65), lambda k: a.h[k] * b.h[k]))::BIGINT AS n11
  FROM ones a JOIN ones b ON a.chrom = b.chrom AND b.i BETWEEN a.i AND a.i + 250 AND -45672::DOUBLE * (b.g - a.g) / 64::DOUBLE >= ln({CUTOFF}::DOUBLE)
),
cov AS MATERIALIZED (
  SELECT chrom, lo, hi, CASE WHEN ia = ib THEN v + {scalar.diagonal_adjustment(_THETA)!r}::DOUBLE ELSE v END AS s, naive, ga, gb, ia, ib
  FROM (SELECT *, {(1 - _THETA) * (1 - _THETA)!r}::DOUBLE * naive * exp(-45672::DOUBLE * (gb - ga) / 64::DOUBLE) AS v FROM (SELECT *, n11 / 64::DOUBLE - (n1a / 64::DOUBLE) * (n1b / 64::DOUBLE) AS naive FROM near))
  WHERE abs(v) >= {CUTOFF}::DOUBLE
),
sizes AS (SELECT chrom, count(*) AS n, count(*) // {WINDOW} AS chunks FROM panel GROUP BY chrom),
cuts AS (SELECT chrom, n, chunks, unnest(range(chunks)) AS k FROM sizes),
parts AS MATERIALIZED (
  SELECT c.chrom, c.k::INT AS p_index, s.pos AS "start", e.pos AS "end" FROM (
    SELECT c.chrom, c.k, CASE WHEN c.k = any_value(c.chunks) - 1 THEN any_value(c.n) - 1 ELSE least(coalesce(min(t.i) FILTER (t.g - b.g >= 0 AND exp(-45672::DOUBLE * (t.g - b.g) / 64::DOUBLE) < 1.5e-8::DOUBLE), any_value(c.n)), any_value(c.n) - 1) END AS stop
    FROM cuts c JOIN panel b ON b.chrom = c.chrom AND b.i = (c.k + 1) * {WINDOW} - 1 LEFT JOIN panel t ON t.chrom = c.chrom AND t.i >= (c.k + 1) * {WINDOW} + 1
    GROUP BY c.chrom, c.k
  ) c JOIN panel s ON s.chrom = c.chrom AND s.i = c.k * {WINDOW} JOIN panel e ON e.chrom = c.chrom AND e.i = c.stop
),
pcov AS MATERIALIZED (SELECT cov.*, p_index FROM cov JOIN parts p ON cov.chrom = p.chrom AND lo >= p."start" AND hi <= p."end"),
bounds AS (
  SELECT chrom, p_index, coalesce(lag("start") OVER w, -1) < 0 AS is_first, CASE WHEN lag("start") OVER w IS NULL THEN min("start") OVER (PARTITION BY chrom) ELSE "start" END AS own_lo,
         coalesce(lead("start") OVER w, max("end") OVER (PARTITION BY chrom)) AS own_hi, min("start") OVER (PARTITION BY chrom) AS snp_first, max("end") OVER (PARTITION BY chrom) AS snp_last
  FROM parts WINDOW w AS (PARTITION BY chrom ORDER BY p_index)
),
own AS MATERIALIZED (SELECT c.* FROM pcov c JOIN bounds b USING (chrom, p_index) WHERE (lo > own_lo OR (is_first AND lo >= own_lo)) AND lo <= own_hi AND lo >= snp_first AND hi <= snp_last),
diag AS MATERIALIZED (SELECT chrom, lo AS pos, arg_min(s, p_index) AS d FROM own WHERE lo = hi GROUP BY chrom, lo),
r2 AS MATERIALIZED (SELECT o.chrom, o.lo, o.hi, o.s * o.s / (a.d * b.d) AS r2 FROM (SELECT chrom, lo, hi, arg_min(s, p_index) AS s FROM own GROUP BY ALL) o JOIN diag a ON a.chrom = o.chrom AND a.pos = o.lo JOIN diag b ON b.chrom = o.chrom AND b.pos = o.hi WHERE a.d > 0 AND b.d > 0),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY chrom, p_index ORDER BY pos) - 1 AS rk FROM (SELECT DISTINCT chrom, p_index, lo AS pos FROM pcov)),
pdiag AS (SELECT c.chrom, c.p_index, c.lo AS pos, c.s AS d, k.rk FROM pcov c JOIN ranked k ON k.chrom = c.chrom AND k.p_index = c.p_index AND k.pos = c.lo WHERE c.lo = c.hi AND c.s > 0),
edges AS (
  SELECT chrom, p_index, lag(edge) OVER (PARTITION BY chrom ORDER BY p_index) AS below, CASE WHEN nx IS NULL THEN least(edge, top - 1) ELSE edge END AS edge, sf, sl FROM (
    SELECT p.chrom, p_index, lead("start") OVER w AS nx, coalesce(("end" + lead("start") OVER w) // 2, max("end") OVER (PARTITION BY p.chrom)) AS edge, min("start") OVER (PARTITION BY p.chrom) AS sf, max("end") OVER (PARTITION BY p.chrom) AS sl, t.top
    FROM parts p JOIN (SELECT chrom, max(pos) AS top FROM ranked GROUP BY chrom) t ON t.chrom = p.chrom WINDOW w AS (PARTITION BY p.chrom ORDER BY p_index))
),
vec AS MATERIALIZED (
  SELECT v.chrom, k.pos, sum(v.r2) AS value FROM (
    SELECT c.chrom, c.p_index, (a.rk + b.rk) // 2 AS rk, c.s * c.s / (a.d * b.d) AS r2 FROM pcov c
    JOIN pdiag a ON a.chrom = c.chrom AND a.p_index = c.p_index AND a.pos = c.lo JOIN pdiag b ON b.chrom = c.chrom AND b.p_index = c.p_index AND b.pos = c.hi WHERE (b.rk - a.rk) % 2 = 0 OR a.rk > 0
  ) v JOIN ranked k ON k.chrom = v.chrom AND k.p_index = v.p_index AND k.rk = v.rk JOIN edges e ON e.chrom = v.chrom AND e.p_index = v.p_index
  WHERE k.pos <= e.edge AND k.pos <= e.sl AND (k.pos > e.below OR (e.below IS NULL AND k.pos >= e.sf)) GROUP BY v.chrom, k.pos HAVING sum(v.r2) > 0
),
vecn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS idx, count(*) OVER (PARTITION BY chrom) AS n FROM vec),
taps AS (SELECT w AS width, k, pow(sin(pi() * k / (2 * w)::DOUBLE), 2) AS raw FROM (SELECT w, unnest(range(2 * w + 1)) AS k FROM (VALUES (5), (10), (20)) t(w))),
tapn AS MATERIALIZED (SELECT width, k, raw / sum(raw) OVER (PARTITION BY width) AS w FROM taps),
refl AS (SELECT v.chrom, v.idx, v.pos, t.width, t.w, v.n, ((v.idx - t.width + t.k) % (2 * v.n) + 2 * v.n) % (2 * v.n) AS m FROM vecn v, tapn t),
smooth AS MATERIALIZED (SELECT r.chrom, r.width, r.idx, r.pos, sum(u.value * r.w) AS s FROM refl r JOIN vecn u ON u.chrom = r.chrom AND u.idx = CASE WHEN r.m < r.n THEN r.m ELSE 2 * r.n - 1 - r.m END GROUP BY ALL),
flagged AS MATERIALIZED (SELECT *, coalesce(s < lag(s) OVER w AND s < lead(s) OVER w, false) AS is_minimum FROM smooth WINDOW w AS (PARTITION BY chrom, width ORDER BY idx)),
bp AS MATERIALIZED (SELECT chrom, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS idx, pos AS locus FROM flagged WHERE width = 10 AND is_minimum),
blk AS MATERIALIZED (SELECT p.chrom, p.pos, count(b.locus) AS b FROM (SELECT DISTINCT chrom, lo AS pos FROM own UNION SELECT DISTINCT chrom, hi FROM own) p LEFT JOIN bp b ON b.chrom = p.chrom AND b.locus < p.pos GROUP BY p.chrom, p.pos),
cross_ AS MATERIALIZED (SELECT r.*, x.b AS bx, y.b AS by_ FROM r2 r JOIN blk x ON x.chrom = r.chrom AND x.pos = r.lo JOIN blk y ON y.chrom = r.chrom AND y.pos = r.hi WHERE lo < hi AND x.b <> y.b),
loci AS (SELECT DISTINCT chrom, lo AS pos FROM own),
met AS MATERIALIZED (
  SELECT e.chrom, coalesce(s, 0) AS sum, coalesce(c, 0) AS n_nonzero, CASE WHEN k <= 1 THEN 0 ELSE z END::DOUBLE AS n_zero
  FROM (SELECT chrom, count(*) AS k FROM bp GROUP BY chrom) e LEFT JOIN (SELECT chrom, sum(r2) AS s, count(*) AS c FROM cross_ GROUP BY chrom) USING (chrom)
  LEFT JOIN (SELECT chrom, (sum(w) * sum(w) - sum(w * w)) / 2 AS z FROM (SELECT l.chrom, k.b, count(*)::DOUBLE AS w FROM loci l JOIN blk k USING (chrom, pos) WHERE l.pos <= (SELECT max(locus) FROM bp WHERE bp.chrom = l.chrom) GROUP BY l.chrom, k.b) GROUP BY chrom) USING (chrom)
),
rmap AS MATERIALIZED (SELECT 'm1' AS chrom, p_partkey AS row_no, p_partkey * 1000 AS pos, p_retailprice / 1000 AS rate, sum(p_retailprice / 1000 * 0.001::DOUBLE) OVER (ORDER BY p_partkey) AS cum_cm FROM part),
snps AS MATERIALIZED (SELECT 'm1' AS chrom, o_orderkey * 7919 % ((SELECT count(*) FROM part) * 1000 + 3000) AS pos, 'rs' || o_orderkey AS rs_id FROM orders),
pa AS MATERIALIZED (SELECT DISTINCT 'chr' || c_nationkey AS chrom, c_custkey * 1000 + c_custkey * 37 % 501 AS pos FROM customer),
pb AS MATERIALIZED (SELECT DISTINCT 'chr' || s_nationkey AS chrom, s_suppkey * 15000 + s_suppkey * 53 % 777 AS pos FROM supplier),
ba AS MATERIALIZED (SELECT * FROM (SELECT chrom, pos AS "start", lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS stop FROM pa) WHERE stop IS NOT NULL),
bb AS MATERIALIZED (SELECT * FROM (SELECT chrom, pos AS "start", lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS stop FROM pb) WHERE stop IS NOT NULL),
xa AS MATERIALIZED (SELECT chrom, "start" AS pos FROM ba UNION SELECT chrom, stop FROM ba),
xb AS MATERIALIZED (SELECT chrom, "start" AS pos FROM bb UNION SELECT chrom, stop FROM bb),
ivs AS MATERIALIZED (SELECT 'u' || (user_id % 20) AS chrom, floor(epoch(ts))::BIGINT AS "start", floor(epoch(ts))::BIGINT + floor(abs(value) * 60)::BIGINT + 1 AS stop FROM events),
merged AS MATERIALIZED (
  SELECT chrom, min("start") AS "start", max(stop) AS stop FROM (SELECT *, sum(n) OVER (PARTITION BY chrom ORDER BY "start", stop ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN "start" <= max(stop) OVER (PARTITION BY chrom ORDER BY "start", stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM ivs)) GROUP BY chrom, g
),
rec AS (SELECT 'c' || l_suppkey AS chrom, l_partkey AS pos, l_orderkey * 10 + l_linenumber AS record_no, l_extendedprice AS value, l_linenumber::BIGINT AS line FROM lineitem)
"""


def sql(final: str, more: str = "") -> str:
    return f"WITH {SQL}{',' + more if more else ''}\n{final}"
