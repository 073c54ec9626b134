"""Toxicity: cumulative-link (proportional odds) regression on sparse word features.

Grades: 0 for a document labelled clean; documents labelled toxic get 1 to
`GRADES` by how often they use words that mark toxic documents (equal thirds),
where the marking words are learned from the other half of the labelled rows, so
no row's grade comes from its own label. One weight vector is shared by all thresholds:
P(grade > k) = 1 / (1 + exp(threshold_k - w.x)); thresholds ascend, as each is
the one before plus exp of a parameter. The fit maximises the likelihood of the
grades, P(grade = k) = P(grade > k - 1) - P(grade > k); the expected severity is
the sum of P(grade > k) over k.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import chunked_array, lean, materialize, text_chunks
from .labelled import labelled_sample

GRADES = 3
#: Bounds of the fit: labelled rows (chosen by hash) and features kept.
MAX_LABELLED = 8_000
MAX_FEATURES = 512
MIN_DOCUMENTS = 4
PREFIXES = (4, 5, 6)
RIDGE = 2e-5
#: A word counts as one that tells from this gain on, and marks toxic documents from this lift on.
MIN_GAIN, MARK_LIFT = 6, 2
#: What toxic documents weigh together; below a half, since a filter had better keep a doubtful document.
TOXIC_WEIGHT = 1 / 3
U0 = np.uint64(0)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word and of the first 4, 5 and 6 bytes of longer words, so that a stem counts with any ending."""
    starts, ends, bounds = words.spans(data, offsets)
    rows = words.row_of(bounds)
    keys, of = [words.hashes(data, starts, ends)], [rows]
    for n in PREFIXES:
        long = ends - starts > n
        keys.append(words.hashes(data, starts[long], starts[long] + n) ^ np.uint64(n))
        of.append(rows[long])
    return np.concatenate(keys), np.concatenate(of)


@dataclass
class Model:
    """features: sorted word hashes; weights beside them; thresholds ascending."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) of each row and k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -60, 60)))

    def link(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """w.x of each row of a text chunk."""
        n = len(offsets) - 1
        if not len(data) or not len(self.features):
            return np.zeros(n)
        hashed, rows = features(data, offsets)
        at = np.minimum(np.searchsorted(self.features, hashed), len(self.features) - 1)
        known = self.features[at] == hashed
        key, count = np.unique(rows[known] * len(self.features) + at[known], return_counts=True)
        return np.bincount(key // len(self.features), self.weights[key % len(self.features)] * np.log1p(count), n)


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, words (hashes), counts of each text."""
    for batch, data, offsets in text_chunks(batches):
        hashed, rows = features(data, offsets) if len(data) else (np.empty(0, np.uint64), np.empty(0, np.int64))
        order = np.lexsort((hashed, rows))
        hashed, rows = hashed[order], rows[order]
        first = np.flatnonzero((np.diff(rows, prepend=-1) != 0) | (np.diff(hashed, prepend=U0) != 0))
        at = pa.array(np.searchsorted(rows[first], np.arange(len(batch) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(at, x) for x in (pa.array(hashed[first].view(np.int64)), pa.array(np.diff(np.append(first, len(rows))).astype(np.int32)))]
        yield pa.RecordBatch.from_arrays([batch.column("label"), *lists], ["label", "words", "counts"])


def word_statistics(rows: DataFrame) -> DataFrame:
    """word, gain (log-likelihood ratio of its share of toxic and of clean documents), lift (log of how many times likelier in toxic ones) of the words of MIN_DOCUMENTS rows and more."""
    toxic, every = rows.agg(F.coalesce(F.sum((F.col("label") > 0).cast("bigint")), F.lit(0)), F.count(F.lit(1))).first()
    clean = every - toxic
    seen = rows.select((F.col("label") > 0).cast("bigint").alias("t"), F.explode("words").alias("word")).groupBy("word").agg(F.sum("t").alias("a"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= (MIN_DOCUMENTS if toxic and clean else every + 1))
    a, b = F.col("a"), F.col("n") - F.col("a")
    p, q, both = (a + 0.5) / (toxic + 1), (b + 0.5) / (clean + 1), (F.col("n") + 1) / (every + 2)
    gain = a * F.log(p / both) + (toxic - a) * F.log((1 - p) / (1 - both)) + b * F.log(q / both) + (clean - b) * F.log((1 - q) / (1 - both))
    return seen.select("word", F.round(gain, 9).alias("gain"), F.log(p / q).alias("lift"))


def select_words(rows: DataFrame) -> list[int]:
    """The MAX_FEATURES words (hashes, ascending) of the highest gain."""
    best = word_statistics(rows).filter(F.col("gain") > MIN_GAIN).orderBy(F.desc("gain"), "word").limit(MAX_FEATURES)
    return sorted((r["word"] for r in best.collect()), key=lambda x: x % (1 << 64))


def doses(rows: DataFrame) -> DataFrame:
    """row, dose: how often a row has words that mark toxic documents in the other half of the rows; rows with none are left out."""
    half = F.pmod(F.xxhash64("words"), F.lit(2))
    out = None
    for f in (0, 1):
        marks = word_statistics(rows.filter(half == 1 - f)).filter((F.col("gain") > MIN_GAIN) & (F.col("lift") > MARK_LIFT)).select("word")
        own = rows.filter(half == f).select("row", F.explode(F.arrays_zip("words", "counts")).alias("p")).select("row", F.col("p.words").alias("word"), F.col("p.counts").alias("n"))
        part = own.join(marks, "word").groupBy("row").agg(F.sum("n").alias("dose"))
        out = part if out is None else out.unionByName(part)
    return out


def grades_of(label: np.ndarray, dose: np.ndarray) -> np.ndarray:
    """0 where the label is 0; 1 to GRADES by the dose's quantile among the others."""
    if not (label > 0).any():
        return np.zeros(len(label), np.int64)
    cuts = np.quantile(dose[label > 0], [i / GRADES for i in range(1, GRADES)])
    return np.where(label > 0, 1 + (dose[:, None] > cuts[None, :]).sum(1), 0)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from at most `max_labelled` labelled rows. Without both labels the model calls everything clean.

    Words are counted and chosen as a distributed job; the driver gets the
    grades and the counts of the chosen words.
    """
    sample = labelled_sample(docs, labels, "toxic", max_labelled)
    rows = sample.select("label", "text").mapInArrow(lean(word_counts), "label int, words array<bigint>, counts array<int>")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "labelled")
    chosen = select_words(rows)
    if not chosen:
        return Model(np.empty(0, np.uint64), np.empty(0), np.full(GRADES, 20.0))
    places = F.broadcast(docs.sparkSession.createDataFrame(list(zip(chosen, range(len(chosen)), strict=True)), "word bigint, feature int"))  # at most MAX_FEATURES rows
    known = rows.select("row", "label").join(doses(rows), "row", "left").select("row", "label", F.coalesce("dose", F.lit(0)).alias("dose")).toArrow().sort_by("row")
    pairs = rows.select("row", F.explode(F.arrays_zip("words", "counts")).alias("p")).select("row", F.col("p.words").alias("word"), F.col("p.counts").alias("n")).join(places, "word").select("row", "feature", "n").toArrow().sort_by([("row", "ascending"), ("feature", "ascending")])
    row, label, dose = (known.column(c).to_numpy() for c in ("row", "label", "dose"))
    weights, thresholds = fit_arrays(grades_of(label, dose), np.searchsorted(row, pairs.column("row").to_numpy()), pairs.column("feature").to_numpy(), pairs.column("n").to_numpy().astype(float), len(chosen))
    return Model(np.array(chosen, np.int64).view(np.uint64), weights, thresholds)


def thresholds_of(theta: np.ndarray) -> np.ndarray:
    """Ascending thresholds from the first one and the logs of the steps to the others."""
    return theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))])


def loss_and_gradient(w: np.ndarray, theta: np.ndarray, grade: np.ndarray, scale: np.ndarray, row: np.ndarray, feature: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """-log likelihood of the grades (weighted by scale) with a slight ridge, and its gradients by w and theta."""
    z = np.bincount(row, w[feature] * x, len(grade))
    above = 1 / (1 + np.exp(np.clip(thresholds_of(theta)[None, :] - z[:, None], -60, 60)))
    n, k, every = len(grade), len(theta), np.arange(len(grade))
    padded = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)  # P(grade > -1), P(grade > 0), ..., P(grade > k)
    p = np.maximum(padded[every, grade] - padded[every, grade + 1], 1e-12)
    slope = padded * (1 - padded)
    low, high = slope[every, grade] / p * scale, slope[every, grade + 1] / p * scale
    by_threshold = np.bincount(grade + 1, -high, k + 2)[1:-1] + np.bincount(grade, low, k + 2)[1:-1]
    tail = np.cumsum(by_threshold[::-1])[::-1]
    return float(-(scale * np.log(p)).sum() + RIDGE / 2 * (w**2).sum()), np.bincount(feature, (high - low)[row] * x, len(w)) + RIDGE * w, np.concatenate([tail[:1], tail[1:] * np.exp(theta[1:])])


def fit_arrays(grade: np.ndarray, row: np.ndarray, feature: np.ndarray, count: np.ndarray, n_features: int, rounds: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam; deterministic."""
    grade = grade.astype(np.int64)
    toxic = int((grade > 0).sum())
    scale = np.where(grade > 0, TOXIC_WEIGHT / max(toxic, 1), (1 - TOXIC_WEIGHT) / max(len(grade) - toxic, 1))
    both = np.zeros(n_features + GRADES)
    both[n_features] = 1.0  # the steps between thresholds begin at 1
    x, first, second = np.log1p(count), np.zeros_like(both), np.zeros_like(both)
    for step in range(1, rounds + 1):
        _, by_w, by_theta = loss_and_gradient(both[:n_features], both[n_features:], grade, scale, row, feature, x)
        gradient = np.concatenate([by_w, by_theta])
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        both -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return both[:n_features], thresholds_of(both[n_features:])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (0 to GRADES), p_toxic, toxic (p_toxic >= 0.5) of every row; null text is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_chunks(batches):
            above = shared.value.above(shared.value.link(data, offsets))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5)], ["doc_id", "severity", "p_toxic", "toxic"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id bigint, severity double, p_toxic double, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose p_toxic is below 0.5. Only texts go to Python and only flags come back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from chunked_array(texts, lambda data, offsets: pa.array(shared.value.above(shared.value.link(data, offsets))[:, 0] < 0.5))

    return docs.filter(F.arrow_udf(clean, "boolean")(F.col("text").cast("string")))
