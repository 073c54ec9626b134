"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE_WORDS` words. A small network
encodes each passage, gated attention (tanh times sigmoid) weighs the passages
of a document, and the weighted sum of the encodings is scored. Only the
document's label is known in training; the weights are learned from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import lean, text_chunks
from .labelled import labelled_sample

PASSAGE_WORDS = 64
#: Bound of the fit: labelled rows, chosen by a hash of doc_id.
MAX_LABELLED = 6_000
BUCKETS = 32
HIDDEN, GATE = 24, 12

_KIND = np.zeros((8, 256), np.float32)
for _c in range(256):
    _s = chr(_c) if _c < 128 else "é"
    _KIND[0 if _s.islower() else 1 if _s.isupper() else 2 if _s.isdigit() else 3 if _s == " " else 4 if _s == "\n" else 5 if _s in ".,;:!?'\"-" else 6 if _s.isprintable() else 7, _c] = 1
N_FEATURES = 8 + 8 + BUCKETS


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage and where each row's passages begin. Every row has one at least; the last may be short."""
    n = len(offsets) - 1
    starts, ends, bounds = words.spans(data, offsets)
    per_row = np.maximum(1, -(-np.diff(bounds) // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(per_row)])
    total = int(first[-1])
    rows = words.row_of(bounds)
    of = first[rows] + (np.arange(len(rows)) - bounds[:-1][rows]) // PASSAGE_WORDS if len(rows) else np.empty(0, np.int64)
    # a passage's bytes go from its first word (the row's first byte for the first passage) to the next passage
    begin = np.repeat(offsets[:-1], per_row)
    if len(of):
        heads = np.flatnonzero(np.diff(of, prepend=-1))
        inner = ~np.isin(of[heads], first[:-1])
        begin[of[heads][inner]] = starts[heads][inner]
    finish = np.append(begin[1:], len(data))
    size = np.maximum(finish - begin, 0)
    out = np.zeros((total, N_FEATURES), np.float32)
    if len(data):
        kinds = np.repeat(np.arange(total), size)
        label = _KIND.argmax(0).astype(np.int64)[data]
        out[:, :8] = np.bincount(kinds * 8 + label, minlength=total * 8).reshape(total, 8) / np.maximum(size, 1)[:, None]
    n_words = np.bincount(of, minlength=total).astype(np.float32) if len(of) else np.zeros(total, np.float32)
    some = np.maximum(n_words, 1)
    out[:, 8] = np.log1p(n_words)
    out[:, 9] = np.log1p(size)
    if len(of):
        hashed = words.hashes(data, starts, ends)
        length = (ends - starts).astype(np.float64)
        mean = np.bincount(of, length, total) / some
        out[:, 10] = mean
        out[:, 11] = np.sqrt(np.maximum(np.bincount(of, length**2, total) / some - mean**2, 0))
        out[:, 12] = np.bincount(of, length <= 3, total) / some
        same = np.zeros(len(of), bool)
        same[1:] = (hashed[1:] == hashed[:-1]) & (of[1:] == of[:-1])
        out[:, 13] = np.bincount(of, same, total) / some
        key = np.sort((of.astype(np.uint64) << np.uint64(40)) | (hashed >> np.uint64(24)))
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        out[:, 14] = np.bincount((key >> np.uint64(40)).astype(np.int64), fresh, total) / some
        out[:, 15] = np.bincount(of, (length <= 1), total) / some
        bucket = (hashed % np.uint64(BUCKETS)).astype(np.int64)
        out[:, 16:] = np.bincount(of * BUCKETS + bucket, minlength=total * BUCKETS).reshape(total, BUCKETS) / some[:, None]
    return out, first


class Network:
    """Passage encoder, gated attention, and a logistic score; trained with Adam in numpy."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.mean, self.scale = mean.astype(np.float32), scale.astype(np.float32)
        shape = {"w": (N_FEATURES, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "g": (GATE,), "c": (HIDDEN,), "d": (1,)}
        self.p = {k: (draw.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k in "gc" else np.zeros(s)).astype(np.float32) for k, s in shape.items()}

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, s = self.p, {}
        s["x"] = np.clip((x - self.mean) / self.scale, -8, 8)
        s["h"] = np.tanh(s["x"] @ p["w"] + p["b"])
        s["t"], s["s"] = np.tanh(s["h"] @ p["v"]), 1 / (1 + np.exp(-(s["h"] @ p["u"])))
        e = (s["t"] * s["s"]) @ p["g"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), np.diff(first)))
        s["a"] = e / np.repeat(np.add.reduceat(e, first[:-1]), np.diff(first))
        s["z"] = np.add.reduceat(s["a"][:, None] * s["h"], first[:-1], axis=0)
        s["y"] = 1 / (1 + np.exp(-np.clip(s["z"] @ p["c"] + p["d"], -30, 30)))
        return s

    def gradient(self, x: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, s = self.p, self.forward(x, first)
        reps = np.diff(first)
        dy = ((s["y"] - label) * weight / len(label)).astype(np.float32)
        out = {"c": s["z"].T @ dy, "d": dy.sum(keepdims=True)}
        dz = np.repeat(dy, reps)[:, None] * p["c"]
        dh = s["a"][:, None] * dz
        da = (s["h"] * dz).sum(1)
        mean = np.repeat(np.add.reduceat(s["a"] * da, first[:-1]), reps)
        de = s["a"] * (da - mean)
        out["g"] = (s["t"] * s["s"]).T @ de
        dts = de[:, None] * p["g"]
        dt, ds = dts * s["s"] * (1 - s["t"] ** 2), dts * s["t"] * s["s"] * (1 - s["s"])
        out["v"], out["u"] = s["h"].T @ dt, s["h"].T @ ds
        dh += dt @ p["v"].T + ds @ p["u"].T
        dpre = dh * (1 - s["h"] ** 2)
        out["w"], out["b"] = s["x"].T @ dpre, dpre.sum(0)
        return out

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)["y"].astype(float)


def train(x: np.ndarray, first: np.ndarray, label: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 4e-3, seed: int = 7) -> Network:
    """Fit on bags (features and where they begin); deterministic. No bags at all make a network that says one half."""
    scale = x.std(0) + 1e-3 if len(x) else np.ones(N_FEATURES)
    net = Network(x.mean(0) if len(x) else np.zeros(N_FEATURES), scale, seed)
    if not len(label):
        net.p["c"][:] = 0
        return net
    draw = np.random.default_rng(seed)
    reps = np.diff(first)
    m1, m2, step = {k: 0 * v for k, v in net.p.items()}, {k: 0 * v for k, v in net.p.items()}, 0
    for epoch in range(epochs):
        order = draw.permutation(len(label))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            sizes = reps[pick]
            index = np.repeat(first[pick] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            g = net.gradient(x[index], np.concatenate([[0], np.cumsum(sizes)]), label[pick].astype(np.float32), np.ones(len(pick), np.float32))
            step += 1
            now = rate * (1 - epoch / epochs)
            for k, v in g.items():
                v = v + 1e-4 * net.p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.999 * m2[k] + 0.001 * v * v
                net.p[k] = (net.p[k] - now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", where: Column | None = None, max_labelled: int = MAX_LABELLED) -> Network:
    """Learn from at most `max_labelled` labelled rows that satisfy `where` (a condition on doc_id)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_chunks(batches):
            x, first = passages(data, offsets)
            at = pa.array(first * N_FEATURES, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], ["doc_id", "label", "x"])

    sample = labelled_sample(docs, labels, column, max_labelled, where)
    rows = sample.mapInArrow(lean(encode), "doc_id bigint, label int, x array<float>").toArrow().sort_by("doc_id").combine_chunks()
    bags = rows.column("x").combine_chunks()
    sizes = np.diff(bags.offsets.to_numpy()) // N_FEATURES
    x = bags.flatten().to_numpy().reshape(-1, N_FEATURES)
    return train(x, np.concatenate([[0], np.cumsum(sizes)]), (rows.column("label").to_numpy() > 0).astype(np.float32))


def score(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, score (of label 1) of every row; a null text is an empty one, and an empty text is one empty passage."""
    shared = docs.sparkSession.sparkContext.broadcast(network)  # some 2,000 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(*passages(data, offsets)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id bigint, score double")
