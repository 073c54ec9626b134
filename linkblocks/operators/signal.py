"""Smoothing the vector, its minima, and the search for a filter width."""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Generator, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hann

#: Outputs that one task computes; each is the same sum in the same order wherever the cuts fall.
CHUNK = 65_536


def reflect_index(i: np.ndarray, n: int) -> np.ndarray:
    m = np.mod(i, 2 * n)
    return np.where(m < n, m, 2 * n - 1 - m)


def convolve(values: np.ndarray, width: int, begin: int, end: int, periodic: bool = False, at: int = 0, n: int | None = None) -> np.ndarray:
    """Outputs [begin, end) of the direct convolution with mirrored ends.

    `values` may be a part of the signal that begins at `at` and holds all
    inputs of the outputs; n is the length of the whole. Taps are added one
    after another, so equal neighbourhoods give equal results to the last bit
    and a plateau has no minima.
    """
    weights, n = hann(width, periodic), len(values) if n is None else n
    if not n or begin >= end:
        return np.empty(0)
    padded = values[reflect_index(np.arange(begin - width, end + width), n) - at]
    out = np.zeros(end - begin)
    for t, w in enumerate(weights):
        out += w * padded[t : t + end - begin]
    return out


def arrays(vector: DataFrame) -> DataFrame:
    """chrom, positions, values: one row a chromosome, in order of position."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "value")))
    return vector.groupBy("chrom").agg(rows.alias("v")).select("chrom", F.col("v.pos").alias("positions"), F.col("v.value").alias("values"))


def _chunks(signals: DataFrame, widths: list[int] | dict[str, list[int]], chunk: int) -> DataFrame:
    """chrom, width, begin, end, n, at, values, positions: outputs [begin, end) with the part of the signal, from `at`, that they need."""
    if isinstance(widths, dict):
        of = F.create_map(*[x for c, w in widths.items() for x in (F.lit(c), F.array(*[F.lit(int(v)) for v in w]))])
        wanted = F.explode(F.try_element_at(of, F.col("chrom"))) if widths else F.explode(F.array().cast("array<int>"))
    else:
        wanted = F.explode(F.array(*[F.lit(int(w)) for w in widths]))
    tasks = signals.withColumn("width", wanted).withColumn("n", F.size("values"))
    tasks = tasks.withColumn("begin", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(chunk)))).withColumn("end", F.least("n", F.col("begin") + chunk))
    tasks = tasks.withColumn("at", F.greatest(F.lit(0), F.col("begin") - F.col("width") - 1))
    part = F.slice("values", F.col("at") + 1, F.least("n", F.col("end") + F.col("width") + 1) - F.col("at"))
    tasks = tasks.select("chrom", "width", "begin", "end", "n", "at", part.alias("values"), F.slice("positions", F.col("begin") + 1, F.col("end") - F.col("begin")).alias("positions"))
    return tasks.repartition(F.col("chrom"), F.col("width"), F.col("begin"))


def _minima(values: np.ndarray, width: int, begin: int, end: int, periodic: bool, at: int = 0, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed outputs [begin, end), and which are strict minima (never the first or last of all)."""
    n = len(values) if n is None else n
    a, b = max(0, begin - 1), min(n, end + 1)
    s = convolve(values, width, a, b, periodic, at, n)
    low = np.zeros(len(s), bool)
    low[1:-1] = (s[1:-1] < s[:-2]) & (s[1:-1] < s[2:])
    return s[begin - a : end - a], low[begin - a : end - a]


def smooth(vector: DataFrame, widths: list[int] | dict[str, list[int]], periodic: bool = False, chunk: int = CHUNK) -> DataFrame:
    """chrom, width, idx, pos, smoothed, is_minimum for each width (a filter bank; or widths for each chromosome)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                s, low = _minima(np.asarray(row.values, float), row.width, row.begin, row.end, periodic, row.at, row.n)
                yield pd.DataFrame({"chrom": row.chrom, "width": row.width, "idx": np.arange(row.begin, row.end), "pos": np.asarray(row.positions), "smoothed": s, "is_minimum": low})

    return _chunks(arrays(vector), widths, chunk).mapInPandas(run, "chrom string, width int, idx bigint, pos bigint, smoothed double, is_minimum boolean")


def minima_counts(vector: DataFrame, widths: list[int] | dict[str, list[int]], periodic: bool = False, chunk: int = CHUNK) -> DataFrame:
    """chrom, width, minima; widths for all chromosomes, or for each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(r.chrom, r.width, int(_minima(np.asarray(r.values, float), r.width, r.begin, r.end, periodic, r.at, r.n)[1].sum())) for r in batch.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["chrom", "width", "n"])

    return _chunks(arrays(vector), widths, chunk).mapInPandas(run, "chrom string, width int, n bigint").groupBy("chrom", "width").agg(F.sum("n").alias("minima"))


def minima_positions(smoothed: DataFrame) -> DataFrame:
    return smoothed.filter("is_minimum").select("chrom", "width", F.col("pos").alias("locus"))


def target_minima(n_positions: int, between: int) -> int:
    """How many breakpoints leave about `between` positions in a block."""
    target = math.ceil(n_positions / between - 1)
    if target <= 0:
        raise ValueError(f"{n_positions} positions make less than one breakpoint at {between} a block")
    return target


def width_search(target: int, start: int = 1000, delta: int = 200, step: int = 20, limit: float = math.inf) -> Generator[list[int], dict[int, int], int]:
    """Yields the widths whose minima it wants to know, gets their counts, and returns the width whose number of minima is the target, or the nearest that the search rule finds.

    Doubles the width until the count is below the target, bisects for the
    smallest width at or under it on the falling side, then walks to smaller
    widths while they still give exactly the target: in steps, then one by one.
    The bisection asks ahead for what its next two rounds may need.
    """
    if start <= 0 or target <= 0:
        raise ValueError("start and target must be positive")
    if step > delta:
        raise ValueError("step must not exceed delta")
    known: dict[int, int] = {}

    def ask(widths: list[int]) -> Generator[list[int], dict[int, int], None]:
        new = sorted({w for w in widths if w not in known})
        if new:
            known.update((yield new))

    end = start
    while True:
        if end >= limit:
            raise ValueError(f"no width below {limit} has fewer than {target} minima")
        yield from ask([end])
        if known[end] < target:
            break
        end *= 2
    low, high = 0, end + 1  # index i stands for width end - i
    while low < high:
        middle = (low + high) // 2
        if end - middle not in known:
            yield from ask([end - j for j in (middle, (low + middle) // 2, (middle + 1 + high) // 2) if 0 <= j <= end])
        if target < known[end - middle]:
            high = middle
        else:
            low = middle + 1
    if not low:
        raise ValueError(f"no width has at most {target} minima")
    at = low - 1
    for reach, by in ((delta, step), (step, 1)):
        while True:
            ahead = [i for i in range(at + by, at + reach, by) if i <= end]
            yield from ask([end - i for i in ahead])
            found = next((i for i in ahead if known[end - i] == target), None)
            if found is None:
                break
            at = found
    return end - at


def search_width(counts: Callable[[list[int]], dict[int, int]], target: int, **options) -> int:
    """width_search of one signal; `counts` gets widths in batches."""
    steps = width_search(target, **options)
    try:
        wanted = next(steps)
        while True:
            wanted = steps.send(counts(wanted))
    except StopIteration as done:
        return done.value


def search_widths(vector: DataFrame, targets: dict[str, int], **options) -> dict[str, int]:
    """A width for every chromosome, with its target number of minima. Each round is one job over all chromosomes that still search."""
    kept = vector.persist()
    try:
        steps, wanted, out = {c: width_search(t, **options) for c, t in targets.items()}, {}, {}
        answers = dict.fromkeys(steps)
        while answers:
            wanted = {}
            for c, answer in answers.items():
                try:
                    wanted[c] = steps[c].send(answer)
                except StopIteration as done:
                    out[c] = done.value
            answers = {c: {} for c in wanted}
            for r in minima_counts(kept, wanted).collect() if wanted else []:
                answers[r["chrom"]][r["width"]] = r["minima"]
        return {c: out[c] for c in targets}
    finally:
        kept.unpersist()


def uniform_breakpoints(vector: DataFrame, counts: DataFrame) -> DataFrame:
    """chrom, idx, locus: every step-th position, step = n // (k + 1), k breakpoints wanted (chrom, k)."""
    along = Window.partitionBy("chrom").orderBy("pos")
    rows = vector.withColumn("at", F.row_number().over(along) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("chrom"))).join(counts, "chrom")
    rows = rows.withColumn("step", F.floor(F.col("n") / (F.col("k") + 1)))
    rows = rows.filter("step > 0 and at >= step and at % step = 0 and at <= n - step")
    return rows.select("chrom", (F.floor(F.col("at") / F.col("step")) - 1).cast("int").alias("idx"), F.col("pos").alias("locus"))


def find_sorted(values: list, x: object, rule: str) -> int:
    """Index in a sorted list of x ('eq'), or of the nearest value lt, le, gt or ge x; ValueError if there is none."""
    left, right = bisect.bisect_left(values, x), bisect.bisect_right(values, x)
    at = {"eq": left if left != right else -1, "lt": left - 1, "le": right - 1, "gt": right if right < len(values) else -1, "ge": left if left < len(values) else -1}[rule]
    if at < 0:
        raise ValueError(f"no value {rule} {x!r}")
    return at


def find_value(values: DataFrame, x: int, rule: str) -> DataFrame:
    """chrom, found: the same over a frame (chrom, value); chromosomes without one have null."""
    v = F.col("value")
    pick = {"eq": F.max(F.when(v == x, v)), "lt": F.max(F.when(v < x, v)), "le": F.max(F.when(v <= x, v)), "gt": F.min(F.when(v > x, v)), "ge": F.min(F.when(v >= x, v))}[rule]
    return values.groupBy("chrom").agg(pick.alias("found"))
