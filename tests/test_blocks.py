"""Intervals, maps, signal and sources against hand-made answers."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkblocks.functions import scalar
from linkblocks.operators import compare, covariance, diagnostics, intervals, local_search, maps, metric, signal, vector
from linkblocks.plans import catalogue, pipeline
from linkblocks.sources import sinks, text
from linkblocks.sources.store import CovarianceStore


def blocks(spark, rows):
    return spark.createDataFrame([("1", *r) for r in rows], "chrom string, start bigint, stop bigint")


def points(spark, rows):
    return spark.createDataFrame([("1", r) for r in rows], "chrom string, pos bigint")


def pairs(df):
    return sorted((r["start"], r["stop"]) for r in df.collect())


def test_interval_algebra(spark):
    assert pairs(intervals.merge(blocks(spark, [(10, 20), (20, 30), (40, 45), (42, 50)]))) == [(10, 30), (40, 50)]
    assert pairs(intervals.intersect(blocks(spark, [(10, 30), (40, 50)]), blocks(spark, [(20, 45)]), 7)) == [(20, 30), (40, 45)]
    assert intervals.bp_jaccard(blocks(spark, [(0, 10)]), blocks(spark, [(5, 15)])).first()["jaccard"] == 0.3333
    near = {r["pos"]: (r["nearest"], r["distance"]) for r in intervals.nearest(points(spark, [9, 20, 31]), points(spark, [10, 30])).collect()}
    assert near == {9: (10, 1), 20: (10, 10), 31: (30, 1)}
    assert intervals.match_rate(points(spark, [9, 20, 31]), points(spark, [10, 30]), 1).first()["rate"] == pytest.approx(2 / 3)
    assert intervals.boundary_jaccard(points(spark, [100, 200, 300]), points(spark, [105, 300]), 10).first()["jaccard"] == pytest.approx(2 / 3)
    assert intervals.boundary_jaccard(points(spark, [100, 101]), points(spark, [100]), 5).first()["jaccard"] == 0.5
    small = blocks(spark, [(10, 14), (14, 100), (100, 200)]).withColumn("n", F.when(F.col("start") == 10, 1).otherwise(200).cast("bigint"))
    assert pairs(intervals.merge_small(small, 100)) == [(10, 100), (100, 200)]
    sizes = lambda ns, least: [r["n"] for r in intervals.merge_small(spark.createDataFrame([("1", i, i + 1, n) for i, n in enumerate(ns)], "chrom string, start bigint, stop bigint, n bigint"), least).orderBy("start").collect()]
    assert sizes([2, 1, 9, 1, 1, 8], 5) == [14, 8] and sizes([2, 4, 9, 1], 5) == [6, 10] and sizes([1, 2], 5) == [3] and sizes([7, 7], 5) == [7, 7]
    rng = np.random.default_rng(2)
    for _ in range(3):
        x, y = ({int(v) for v in rng.integers(0, 300, 25)} for _ in range(2))
        left, right, hits = sorted(x), sorted(y), 0
        for p in left:  # the earliest boundary within reach that is still free
            near = next((q for q in right if abs(p - q) <= 6), None)
            if near is not None:
                hits += 1
                right.remove(near)
        assert intervals.boundary_jaccard(points(spark, sorted(x)), points(spark, sorted(y)), 6).first()["jaccard"] == pytest.approx(hits / (len(x) + len(y) - hits))
    limits = spark.createDataFrame([("1", 5, 99), ("2", 1, 9)], "chrom string, snp_first bigint, snp_last bigint")
    cut = spark.createDataFrame([("1", 50)], "chrom string, locus bigint")
    assert pairs(intervals.blocks_of(cut, limits)) == [(1, 10), (5, 50), (50, 100)]


# Small maps, and what each mode has to make of them.
@pytest.mark.parametrize(
    "mode, rows, snps, want",
    [
        ("point", [(1000, 1, 0.1), (2000, 1, 0.2), (3000, 2, 0.4)], [500, 1000, 1500, 2500, 3500], [0, 0.1, 0.15, 0.3, 0.4]),
        ("interval", [(1000, 1, 0.001), (2000, 2, 0.003), (3000, 0.5, 0.0035)], [500, 1000, 1500, 2000, 2500, 3500], [0, 0, 0.0005, 0.001, 0.002, 0.00325]),
        ("hapmap", [(1000, 1, 0), (2000, 2, 0.001), (3000, 0.5, 0.003)], [500, 1000, 1500, 2500, 3500], [0, 0, 0.0005, 0.002, 0.00325]),
        ("macdonald-decode", [(1000, 1, 0.001), (2000, 2, 0.003), (3000, 0.5, 0.0035)], [500], [0.0005]),
        ("macdonald-pyrho", [(1000, 1, 0), (2000, 2, 0.001), (3000, 0.5, 0.003)], [500, 3500], [0.0005, 1.7515]),
    ],
)
def test_interpolation(spark, mode, rows, snps, want):
    m = spark.createDataFrame([("1", i, p, float(r), float(c)) for i, (p, r, c) in enumerate(rows)], "chrom string, row_no bigint, pos bigint, rate double, cum_cm double")
    s = spark.createDataFrame([("1", i, p, f"rs{p}") for i, p in enumerate(snps)], "chrom string, row_no bigint, pos bigint, rs_id string")
    got = [r["cm"] for r in maps.interpolate(s, m, mode).orderBy("pos").collect()]
    assert got == pytest.approx(want, abs=1e-12)


def test_partitions_of_a_flat_map_run_to_the_end(spark):
    g = spark.createDataFrame([("1", i, 100 * (i + 1), 0.0) for i in range(7)], "chrom string, row_no bigint, pos bigint, cm double")
    got = sorted((r["start"], r["end"]) for r in maps.partition_chromosome(g, 4, window=3).collect())
    assert got == [(100, 700), (400, 700)]


def test_window_stops_on_a_map_that_goes_backwards(spark):
    g = [0, 0.1, 0.2, 0.3, 0.05, 0.4, 0.5, 0.6, 0.7, 0.8]
    n, cutoff = 500, 1e-7
    rows = spark.createDataFrame([("1", i, float(x)) for i, x in enumerate(g)], "chrom string, i bigint, g double")
    want = [next((j for j in range(i, len(g)) if -4.0 * 11418.0 * (g[j] - g[i]) / (2.0 * n) < np.log(cutoff)), len(g)) for i in range(len(g))]
    assert [r["stop"] for r in covariance.window_stops(rows, n, cutoff=cutoff).orderBy("i").collect()] == want


def test_covariance_of_a_constant_position_is_absent(spark):
    rows = [("1", 100, "a", 0, 0.0, [0, 0, 0, 0]), ("1", 200, "b", 1, 0.001, [0, 1, 0, 0]), ("1", 300, "c", 2, 0.002, [0, 1, 0, 1]), ("1", 300, "d", 3, 0.002, [1, 1, 1, 1])]
    v = spark.createDataFrame(rows, "chrom string, pos bigint, rs_id string, record_no bigint, g double, haps array<int>")
    panel = covariance.prepare_panel(v)
    assert panel.count() == 3
    cov = covariance.covariance(panel, 4, 2).collect()
    assert {r["lo"] for r in cov} | {r["hi"] for r in cov} == {200, 300}
    theta = scalar.watterson_theta(4)
    diag = next(r["shrink_ld"] for r in cov if r["lo"] == r["hi"] == 200)
    assert diag == pytest.approx((1 - theta) ** 2 * (0.25 - 0.0625) + theta / 2 * (1 - theta / 2), abs=1e-15)


@pytest.mark.parametrize("n", [1, 7, 63, 64, 65, 127, 128, 129])
def test_packing(spark, n):
    bits = [[int(x) for x in np.random.default_rng(n + k).integers(0, 2, n)] for k in range(2)]
    row = spark.createDataFrame([(bits[0], bits[1])], "a array<int>, b array<int>").select(scalar.ones(scalar.pack(F.col("a"))), scalar.common_ones(scalar.pack(F.col("a")), scalar.pack(F.col("b")))).first()
    assert tuple(row) == (sum(bits[0]), sum(x * y for x, y in zip(*bits, strict=True)))


def five_loci(spark):
    r2 = {(100, 200): 0.4, (100, 300): 0.2, (100, 400): 0.1, (200, 300): 0.3, (200, 500): 0.5, (300, 400): 0.7, (400, 500): 0.6}
    loci = [100, 200, 300, 400, 500]
    p = spark.createDataFrame([("1", a, b, v) for (a, b), v in r2.items()], "chrom string, lo bigint, hi bigint, r2 double")
    return r2, loci, p, points(spark, loci)


@pytest.mark.parametrize("cuts", [[300], [200, 400], [100, 300], [200, 300, 400]])
def test_metric(spark, cuts):
    r2, loci, p, l = five_loci(spark)
    got = metric.metric(p, l, spark.createDataFrame([("1", c) for c in cuts], "chrom string, locus bigint")).first()
    exact = metric.metric_decimal([(a, b, str(v)) for (a, b), v in r2.items()], loci, cuts)
    assert got["sum"] == pytest.approx(float(exact["sum"]))
    assert (got["n_nonzero"], got["n_zero"]) == (exact["n_nonzero"], float(exact["n_zero"]))


def brute_search(loci, pairs_, bps, k, first, last, total, n, parts=()):
    start = first if k == 0 else (bps[k - 1] + (bps[k] - bps[k - 1]) // 2)
    stop = last if k == len(bps) - 1 else bps[k] + (bps[k + 1] - bps[k]) // 2
    bottom = bps[k - 1] if k else first
    top = bps[k + 1] if k + 1 < len(bps) else last
    listed = stop
    if parts:
        bottom = bps[k - 1] if k else next(x for x, y in parts if x <= start <= y)
        top = bps[k + 1] if k + 1 < len(bps) else [y for x, y in parts if x <= stop <= y][-1]
        listed = max(stop, [x for x, y in parts if x <= top <= y][-1])
    held = [(a, b, v) for a, b, v in pairs_ if (a > start or (k == 0 and a >= start)) and a <= stop and b <= top]
    change = {x: sum(v for a, _, v in held if a == x) - sum(v for _, b, v in held if b == x) for x in loci}
    seen = [x for x in loci if bottom <= x <= listed]
    at = max(i for i, x in enumerate(seen) if x <= bps[k])
    best, where, dist = total / n, bps[k], 0
    s, m = total, n
    for i in range(at + 1, len(seen)):
        if seen[i] > stop:
            break
        s, m = s + change[seen[i]], m + (len(seen) - 1 - i) - (i - 1)
        if m > 0 and s / m < best:
            best, where, dist = s / m, seen[i], seen[i] - seen[at]
    s, m = total, n
    for i in range(at - 1, -1, -1):
        if seen[i] <= start:
            break
        s, m = s - change[seen[i]], m - ((len(seen) - 1 - i) - (i - 1))
        d = seen[at] - seen[i]
        if m > 0 and (s / m < best or (s / m == best and d < dist)):
            best, where, dist = s / m, seen[i], d
    return where, best


def test_local_search_against_a_loop(spark):
    rng = np.random.default_rng(3)
    loci = [100 * i for i in range(1, 41)]
    rows = [(a, b, float(rng.random())) for i, a in enumerate(loci) for b in loci[i + 1 : i + 6]]
    bps = [700, 1500, 2800]
    p = spark.createDataFrame([("1", *r) for r in rows], "chrom string, lo bigint, hi bigint, r2 double")
    b = spark.createDataFrame([("1", i, x) for i, x in enumerate(bps)], "chrom string, idx bigint, locus bigint")
    limits = spark.createDataFrame([("1", 100, 4000, 100, 4000)], "chrom string, snp_first bigint, snp_last bigint, range_start bigint, range_end bigint")
    totals = metric.metric(p, points(spark, loci), b)
    t = totals.first()
    got = {r["idx"]: (r["refined"], r["metric"]) for r in local_search.search(b, limits, p, points(spark, loci), totals).collect()}
    for k in range(3):
        where, best = brute_search(loci, rows, bps, k, 100, 4000, t["sum"], t["n_zero"])
        assert got[k][0] == where and got[k][1] == pytest.approx(best)
    # a chromosome for each layout: one partition, two, three whose last begins at a breakpoint, and one that ends before the last window
    layouts = {"1": [(100, 4000)], "2": [(100, 2500), (2200, 4000)], "3": [(100, 1400), (200, 3000), (2800, 4000)], "4": [(100, 3000)]}
    frame = spark.createDataFrame([(c, i, *x) for c, parts in layouts.items() for i, x in enumerate(parts)], "chrom string, p_index bigint, start bigint, end bigint")
    every = lambda rows, schema: spark.createDataFrame([(c, *r) for c in layouts for r in rows], schema)
    got = local_search.search(
        every([(i, x) for i, x in enumerate(bps)], b.schema),
        every([(300, 3700, 300, 3700)], limits.schema),
        every(rows, p.schema),
        every([(x,) for x in loci], "chrom string, pos bigint"),
        every([tuple(t)[1:]], totals.schema),
        frame,
    ).collect()
    got = {(r["chrom"], r["idx"]): (r["refined"], r["metric"]) for r in got}
    for c, parts in layouts.items():
        for k in range(3):
            if (c, k) == ("4", 2):
                assert got[c, k] == (2800, None)
                continue
            where, best = brute_search(loci, rows, bps, k, 300, 3700, t["sum"], t["n_zero"], parts)
            assert got[c, k][0] == where and got[c, k][1] == pytest.approx(best)
    # one breakpoint has no empty cells: the original stays, without a metric
    one = b.filter("idx = 0")
    r = local_search.search(one, limits, p, points(spark, loci), metric.metric(p, points(spark, loci), one)).first()
    assert (r["refined"], r["metric"]) == (700, None)


def loop_minima(x, width):
    """Every output as a sum of its own, ends mirrored; and where it is below both neighbours."""
    n, out = len(x), []
    for i in range(n):
        total = 0.0
        for k, w in enumerate(scalar.hann(width)):
            j = (i - width + k) % (2 * n)
            total += w * x[j if j < n else 2 * n - 1 - j]
        out.append(total)
    return out, [i for i in range(1, n - 1) if out[i] < out[i - 1] and out[i] < out[i + 1]]


def test_smoothing_and_minima_equal_a_loop_in_every_chunk(spark):
    rng = np.random.default_rng(11)
    signals = {"1": np.cumsum(rng.normal(0, 1, 83)) + 40, "2": rng.random(31)}
    rows = [(c, 10 * i, float(y)) for c, x in signals.items() for i, y in enumerate(x)]
    v = spark.createDataFrame(rows, "chrom string, pos bigint, value double")
    for chunk in (9, 64, 1000):
        found = signal.smooth(v, [0, 4, 50], chunk=chunk).collect()
        counts = {(r["chrom"], r["width"]): r["minima"] for r in signal.minima_counts(v, [0, 4, 50], chunk=chunk).collect()}
        for c, x in signals.items():
            for w in (0, 4, 50):
                own = sorted((r["idx"], r["smoothed"], r["is_minimum"], r["pos"]) for r in found if r["chrom"] == c and r["width"] == w)
                want, low = loop_minima(x, w)
                assert [r[0] for r in own] == list(range(len(x))) and [r[3] for r in own] == [10 * r[0] for r in own]
                assert [r[1] for r in own] == pytest.approx(want) and [r[0] for r in own if r[2]] == low and counts[c, w] == len(low)
    only = signal.smooth(v, {"2": [4]}).select("chrom", "width").distinct().collect()
    assert [tuple(r) for r in only] == [("2", 4)]


def test_widths_of_all_chromosomes_are_those_of_each(spark):
    rng = np.random.default_rng(3)
    rows = [(c, i, float(y)) for c, n in (("1", 300), ("2", 180), ("3", 240)) for i, y in enumerate(rng.random(n))]
    v = spark.createDataFrame(rows, "chrom string, pos bigint, value double")
    got = signal.search_widths(v, {"1": 8, "2": 5, "3": 4}, start=4, delta=6, step=2)
    for c, target in (("1", 8), ("2", 5), ("3", 4)):
        x = np.array([y for k, _, y in rows if k == c])
        assert got[c] == signal.search_width(lambda ws, x=x: {w: len(loop_minima(x, w)[1]) for w in ws}, target, start=4, delta=6, step=2)


def test_reflection_and_convolution():
    for n, w in ((5, 3), (4, 9), (1, 2)):
        x = np.random.default_rng(n).random(n)
        assert np.array_equal(x[signal.reflect_index(np.arange(-w, n + w), n)], np.pad(x, w, mode="symmetric"))


def test_width_search_follows_the_rule():
    counts = {w: max(0, 60 - w) + (3 if w % 7 == 0 else 0) for w in range(0, 2001)}
    asked = []

    def many(widths):
        asked.append(widths)
        return {w: counts[w] for w in widths}

    width = signal.search_width(many, 20, start=10, delta=20, step=4)
    assert counts[width] == 20 and width < 60
    with pytest.raises(ValueError):
        signal.search_width(many, 0)


def test_vector_of_a_partitioned_matrix_equals_the_whole(spark):
    loci = list(range(1000, 3000, 100))
    rows = [("1", a, b, 1.0 if a == b else 0.3 / (1 + (b - a) / 100)) for i, a in enumerate(loci) for b in loci[i : i + 4]]
    cov = spark.createDataFrame(rows, "chrom string, lo bigint, hi bigint, shrink_ld double")
    whole = {r["pos"]: r["value"] for r in vector.whole_vector(cov).collect()}
    assert max(whole) == loci[-2] and len(whole) == len(loci) - 1
    parts = spark.createDataFrame([("1", 0, 1000, 2200), ("1", 1, 1800, 2900)], "chrom string, p_index int, start bigint, end bigint")
    cut = {r["pos"]: r["value"] for r in vector.to_vector(covariance.by_partition(cov, parts), parts).collect()}
    assert cut == pytest.approx(whole)


def test_store_round_trip_and_resume(spark, tmp_path):
    store = CovarianceStore(spark, str(tmp_path / "cov"))
    assert store.present() == set()
    rows = spark.createDataFrame([("1", 0, 1, 2, 0.5), ("1", 1, 2, 2, 1.0)], "chrom string, p_index int, lo bigint, hi bigint, shrink_ld double")
    store.write(rows)
    store.write(rows.filter("p_index = 1").withColumn("shrink_ld", F.lit(2.0)))
    assert sorted((r["p_index"], r["shrink_ld"]) for r in store.read().collect()) == [(0, 0.5), (1, 2.0)]
    assert store.present() == {("1", 0), ("1", 1)}
    with pytest.raises(ValueError):
        store.read(full=True)


def test_run_from_vcf_to_blocks(spark, tmp_path):
    rng = np.random.default_rng(1)
    n, people = 120, 12
    base = rng.integers(0, 2, (n, 2 * people))
    for i in range(1, n):
        if i % 30:
            keep = rng.random(2 * people) < 0.85
            base[i, keep] = base[i - 1, keep]
    samples = [f"s{k}" for k in range(people)]
    lines = ["##fileformat=VCFv4.2", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]
    for i in range(n):
        lines.append("\t".join(["7", str(1000 + 50 * i), f"rs{i}", "A", "G", ".", ".", ".", "GT", *[f"{base[i, 2 * k]}|{base[i, 2 * k + 1]}" for k in range(people)]]))
    lines.append("\t".join(["7", "1000", "again", "A", "G", ".", ".", ".", "GT", *["0|1"] * people]))
    lines.append("\t".join(["7", "1050", "unphased", "A", "G", ".", ".", ".", "GT", *["0/1"] * people]))
    for line in lines[2:]:  # the same again as chromosome 8
        lines.append("8" + line[1:])
    vcf, gmap = tmp_path / "p.vcf.gz", tmp_path / "g.gz"
    vcf.write_bytes(gzip.compress(("\n".join(lines) + "\n").encode()))
    gmap.write_bytes(gzip.compress("".join(f"{c} {1000 + 50 * i} {i * 0.0004 + (i // 30) * 0.02}\n" for c in ("chr7", "8", "9") for i in range(n)).encode()))
    seen = text.read_vcf(spark, str(vcf))
    assert tuple(text.skip_counts(seen).filter("chrom = '7'").select("records", "unphased", "duplicates").first()) == (n + 2, 1, 1)
    with pytest.raises(ValueError, match="nobody"):
        text.read_vcf(spark, str(vcf), ["s1", "nobody"])
    options = {"window": 40, "n_bpoints": 3, "search": {"start": 5, "delta": 10, "step": 2}}
    with pytest.warns(UserWarning, match="1 unphased or incomplete records and 1 repeated positions"):
        paths = pipeline.run(spark, str(vcf), str(gmap), str(tmp_path / "out"), **options)
    both = text.read_blocks(spark, paths["blocks"]).orderBy("start").collect()
    got = [r for r in both if r["chrom"] == "7"]
    assert [(r["start"], r["stop"]) for r in got] == [(r["start"], r["stop"]) for r in both if r["chrom"] == "8"]
    assert got[0]["start"] == 1000 and got[-1]["stop"] == 1000 + 50 * (n - 1) + 1
    assert all(a["stop"] == b["start"] for a, b in zip(got[:-1], got[1:], strict=True))
    saved = json.loads(spark.read.text(paths["breakpoints"]).first()[0])
    assert saved["computed_subsets"] == ["fourier", "fourier_ls"] and len(saved["subsets"]["fourier_ls"]["loci"]) == len(got) - 1
    # a second run takes the stored partitions, one with another cutoff does not
    store = CovarianceStore(spark, paths["covariance"])
    rows = store.read().count()
    store.write(spark.createDataFrame([("8", 0, 1000, 1000, 1.0)], "chrom string, p_index int, lo bigint, hi bigint, shrink_ld double"))
    with pytest.warns(UserWarning):
        assert store.read().count() < rows
        pipeline.run(spark, str(vcf), str(gmap), str(tmp_path / "out"), cutoff=1e-6, **options)
    assert store.read().count() > 0.5 * rows


def test_mismatch_classes(spark):
    ref = blocks(spark, [(0, 100), (100, 200)])
    got = {r["pos"]: r["class"] for r in compare.classify_mismatches(points(spark, [0, 50, 104, 200]), points(spark, [0, 100, 200]), ref).collect()}
    assert got == {0: "shifted_boundary", 50: "extra_split", 104: "shifted_boundary", 200: "shifted_boundary"}


def test_sample_query_counts_every_pair(spark, monkeypatch):
    rows = spark.range(200_003).select(F.lit("c1").alias("chrom"), F.lit(7).alias("boundary"), F.lit("across").alias("category"), F.col("id").alias("lo"), (F.col("id") + 1).alias("hi"), F.lit(0.5).alias("r2"))
    monkeypatch.setattr(catalogue, "_separation", lambda s, d: rows)
    assert [tuple(r) for r in catalogue.QUERIES["agg_17_sample"](spark, "").collect()] == [("c1", "across", 200_003, 100_001.5)]
    assert diagnostics.sample(rows, 5).count() == 5 and diagnostics.sample(rows.limit(4), 5).count() == 4


def test_text_sinks(spark, tmp_path):
    sinks.write_bed(blocks(spark, [(5, 10), (10, 20)]), str(tmp_path / "b"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "b")).collect()] == ["#chr\tstart\tstop", "1\t5\t10", "1\t10\t20"]
    v = spark.createDataFrame([("1", 2, 0.5), ("1", 1, 1.5)], "chrom string, pos bigint, value double")
    sinks.write_vector(v, str(tmp_path / "v"), "1")
    assert [tuple(r) for r in text.read_vector(spark, str(tmp_path / "v"), "1").orderBy("pos").collect()] == [("1", 1, 1.5), ("1", 2, 0.5)]


def test_streaming_store(spark, tmp_path):
    from linkblocks.streaming.incremental import follow

    rows = spark.createDataFrame([(1, 2, 0.5, "1", 0)], "lo bigint, hi bigint, shrink_ld double, chrom string, p_index int")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        follow(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination(60)
    assert CovarianceStore(spark, str(tmp_path / "store")).read().count() == 1
