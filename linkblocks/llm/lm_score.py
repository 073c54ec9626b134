"""Masked pseudo-likelihood of documents under a small bidirectional window network.

Every word is predicted from the two words before and the two after it. The
network reads words as ids, ordered by falling count: the most frequent words
of the whole corpus have their own, the others share buckets. Its output is the
probability of the id itself, a softmax in three steps down a tree (an id
written with three digits of base `branch`; each digit depends on the context
and on the digits before it):

    hidden = tanh(sum over offsets of table[offset][neighbour] + bias)
    P(id | both sides) = product over digits of softmax(hidden . out[digits before] + prior[digits before])[digit]

A word of a bucket has the bucket's probability times its own share of the
bucket's count; the counts of all words stay a distributed table. A document's
score is the sum of log P over its words.

Training deals documents by a hash into units of about UNIT_WORDS words, however
the table is partitioned, and units into rounds, so that all rounds together
read every document once (small corpora several times). In a round every unit
takes its own copy of the network through its documents in numpy (Adagrad, a
step for STEP_WORDS words); copies and their sums of squares are averaged,
weighted by words, by a tree of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import lean, materialize, text_chunks

VOCABULARY, BUCKETS, HIDDEN = 8192, 1024, 16
OFFSETS = (-2, -1, 1, 2)
STEP_WORDS, RATE = 32_768, 0.15
#: Words of a unit, and rounds that units are dealt into.
UNIT_WORDS, ROUNDS = 1 << 21, 6
#: Slices of the parameters that are averaged apart from each other; copies that one task averages.
SLICES, FAN_IN = 64, 256
LEVELS = 3
_NEVER = -1e4


@dataclass
class Vocabulary:
    """Sorted hashes of the frequent words with their ids; ids of buckets; log mass of every id; base of an id's digits; log share of each digit after those before it."""

    hashes: np.ndarray
    ids: np.ndarray
    buckets: np.ndarray
    mass: np.ndarray
    branch: int
    priors: list[np.ndarray]

    @property
    def n_ids(self) -> int:
        return len(self.mass)

    def encode(self, hashed: np.ndarray) -> np.ndarray:
        out = self.buckets[(hashed % np.uint64(len(self.buckets))).astype(np.int64)]
        if len(self.ids):
            at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
            known = self.hashes[at] == hashed
            out[known] = self.ids[at[known]]
        return out


def build_vocabulary(frequent: np.ndarray, counts: np.ndarray, rest: np.ndarray) -> Vocabulary:
    """frequent: hashes; counts beside them; rest: total of each bucket of the other words."""
    mass = np.concatenate([counts, rest]).astype(float) + 0.5
    order = np.argsort(-mass, kind="stable")
    rank = np.empty(len(mass), np.int64)
    rank[order] = np.arange(len(mass))
    sort, branch = np.argsort(frequent), max(2, int(np.ceil(len(mass) ** (1 / LEVELS) - 1e-9)))
    leaves = np.concatenate([mass[order], np.zeros(branch**LEVELS - len(mass))])
    priors = []
    for level in range(1, LEVELS + 1):
        own = leaves.reshape(branch**level, -1).sum(1).reshape(-1, branch)
        with np.errstate(divide="ignore", invalid="ignore"):
            priors.append(np.maximum(np.nan_to_num(np.log(own) - np.log(own.sum(1, keepdims=True)), nan=_NEVER, neginf=_NEVER), _NEVER).astype(np.float32))
    return Vocabulary(frequent[sort], rank[: len(frequent)][sort], rank[len(frequent) :], np.log(mass[order]), branch, priors)


def _by_id(ids: np.ndarray) -> np.ndarray:
    """Order of falling frequency; small integers are sorted by radix."""
    return np.argsort(ids.astype(np.uint16) if len(ids) and ids.max() < 1 << 16 else ids, kind="stable")


class Network:
    """Parameters in one flat float32 array: offset tables (the last row stands for 'no word'), bias, output of each level."""

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray | None = None, seed: int = 3):
        self.vocabulary = vocabulary
        n, b = vocabulary.n_ids + 1, vocabulary.branch
        shapes = [(len(OFFSETS), n, HIDDEN), (HIDDEN,), *[(b**k, HIDDEN, b) for k in range(LEVELS)]]
        sizes = [int(np.prod(s)) for s in shapes]
        if flat is None:
            draw = np.random.default_rng(seed)
            flat = np.concatenate([draw.normal(0, 0.1, sizes[0]), np.zeros(sum(sizes[1:]))])
        self.flat = flat.astype(np.float32).copy()
        self.tables, self.bias, *self.out = self.parts(self.flat, shapes)
        self.shapes = shapes

    @staticmethod
    def parts(flat: np.ndarray, shapes: list[tuple]) -> list[np.ndarray]:
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])
        return [x.reshape(s) for x, s in zip(np.split(flat, cuts[:-1]), shapes, strict=True)]

    def contexts(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(offsets, words) ids of the neighbours; beyond a document's ends the id of 'no word'."""
        reach = max(OFFSETS)
        at = np.arange(len(ids)) + reach * (words.row_of(bounds) + 1)
        spaced = np.full(len(ids) + reach * len(bounds), self.vocabulary.n_ids, np.int32)
        spaced[at] = ids
        return np.stack([spaced[at + k] for k in OFFSETS])

    def hidden(self, near: np.ndarray) -> np.ndarray:
        out = self.tables[0].take(near[0], axis=0)
        for i in range(1, len(OFFSETS)):
            out += self.tables[i].take(near[i], axis=0)
        out += self.bias
        return np.tanh(out, out=out)

    def level(self, k: int, hidden: np.ndarray, sorted_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For words sorted by id: softmax of the k-th digit, the digit, and the groups of words (number, first word) that share the digits before it."""
        b = self.vocabulary.branch
        own, digit = np.divmod(sorted_ids // b ** (LEVELS - 1 - k), b)
        first = np.flatnonzero(np.diff(own, prepend=-1))
        z = self.vocabulary.priors[k].take(own, axis=0)
        for g, start, end in zip(own[first].tolist(), first.tolist(), [*first[1:].tolist(), len(own)], strict=True):
            z[start:end] += hidden[start:end] @ self.out[k][g]
        np.exp(np.minimum(z, 80, out=z), out=z)
        z /= (z @ np.ones(b, np.float32))[:, None]
        return z, digit, own[first], first

    def log_probabilities(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log P(id | both sides) of every word."""
        near, out = self.contexts(ids, bounds), np.zeros(len(ids))
        for a in range(0, len(ids), STEP_WORDS):
            own = ids[a : a + STEP_WORDS].astype(np.int32)
            order = _by_id(own)
            hidden, total = self.hidden(near[:, a : a + STEP_WORDS][:, order]), np.ones(len(own))
            for k in range(LEVELS):
                z, digit, _, _ = self.level(k, hidden, own[order])
                total *= z[np.arange(len(own)), digit]
            out[a + order] = np.log(total + 1e-300)
        return out

    def gradient(self, ids: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Of the sum of -log P over words, laid out as flat."""
        order = _by_id(ids)
        ids, near = ids[order].astype(np.int32), near[:, order]
        hidden = self.hidden(near)
        flat = np.zeros_like(self.flat)
        tables, bias, *out = self.parts(flat, self.shapes)
        d_hidden = np.zeros_like(hidden)
        for k in range(LEVELS):
            error, digit, groups, first = self.level(k, hidden, ids)
            error[np.arange(len(ids)), digit] -= 1
            for g, start, end in zip(groups.tolist(), first.tolist(), [*first[1:].tolist(), len(ids)], strict=True):
                d_hidden[start:end] += error[start:end] @ self.out[k][g].T
                np.matmul(hidden[start:end].T, error[start:end], out=out[k][g])
        d_hidden *= 1 - hidden**2
        n, columns = self.vocabulary.n_ids + 1, np.ascontiguousarray(d_hidden.T, dtype=np.float64)
        for i in range(len(OFFSETS)):
            for j in range(HIDDEN):
                tables[i, :, j] = np.bincount(near[i], columns[j], n)
        bias[:] = d_hidden.sum(0)
        return flat

    def learn(self, ids: np.ndarray, bounds: np.ndarray, squares: np.ndarray, rate: float = RATE) -> None:
        """Adagrad steps over consecutive words; squares: the running sums, laid out as flat."""
        near = self.contexts(ids, bounds)
        for a in range(0, len(ids), STEP_WORDS):
            step = self.gradient(ids[a : a + STEP_WORDS], near[:, a : a + STEP_WORDS])
            squares += step * step
            step *= rate
            step /= np.sqrt(squares) + 1.0
            self.flat -= step


def count_words(docs: DataFrame, limit: int = 400_000) -> DataFrame:
    """hash, n of every word of every document: summed inside a task (flushed at `limit` words), then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["hash", "n"])
        for _, data, offsets in text_chunks(batches):
            starts, ends, _ = words.spans(data, offsets)
            k, c = np.unique(words.hashes(data, starts, ends), return_counts=True)
            both, back = np.unique(np.concatenate([keys, k]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, c]), len(both)).astype(np.int64)
            keys = both
            if len(keys) > limit:
                yield out()
                keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        yield out()

    return docs.select(F.col("text").cast("string")).mapInArrow(lean(run), "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


def corpus_vocabulary(docs: DataFrame, size: int = VOCABULARY, buckets: int = BUCKETS, counts: DataFrame | None = None) -> Vocabulary:
    """The `size` most frequent words (ties by hash) and the mass of the buckets of all others; counts: count_words, where it is at hand."""
    counted = materialize(count_words(docs), "counts") if counts is None else counts
    top = counted.orderBy(F.desc("n"), "hash").limit(size).collect()
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    bucket = F.pmod("hash", F.lit(buckets)).cast("int")  # the low bits, so the sign doesn't matter
    rest = np.zeros(buckets)
    for r in counted.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n")).collect():
        rest[r["b"]] = r["n"]
    hashes = np.array([r["hash"] for r in top], np.int64).view(np.uint64)
    counts = np.array([r["n"] for r in top], float)
    np.subtract.at(rest, (hashes % np.uint64(buckets)).astype(np.int64), counts)
    return build_vocabulary(hashes, counts, np.maximum(rest, 0))


def encode(docs: DataFrame, vocabulary: Vocabulary, unit_words: int = UNIT_WORDS) -> tuple[DataFrame, int]:
    """unit, row, doc_id, ids (a document's, as bytes), rare (hashes of its bucket words) of every row, in the order of a hash of the document within each unit; how many units."""
    units = max(1, round(float(np.exp(vocabulary.mass).sum()) / unit_words))
    kind = np.uint16 if vocabulary.n_ids < 1 << 16 else np.int32
    bucketed = np.zeros(vocabulary.n_ids, bool)
    bucketed[vocabulary.buckets] = True
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_chunks(batches):
            starts, ends, bounds = words.spans(data, offsets)
            hashed = words.hashes(data, starts, ends)
            ids = shared.value.encode(hashed)
            rare, raw = bucketed[ids], ids.astype(kind).tobytes()
            at, of_rare = (bounds * np.dtype(kind).itemsize).astype(np.int32), np.concatenate([[0], np.cumsum(rare)])[bounds]
            coded = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), coded, pa.ListArray.from_arrays(pa.array(of_rare, pa.int32()), pa.array(hashed[rare].view(np.int64)))], ["key", "doc_id", "ids", "rare"])

    text = F.col("text").cast("string")
    coded = docs.select(F.xxhash64("doc_id", text).alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).mapInArrow(lean(run), "key bigint, doc_id bigint, ids binary, rare array<bigint>")
    dealt = coded.withColumn("unit", F.pmod("key", F.lit(units)).cast("int")).repartitionById(units, F.col("unit")).sortWithinPartitions("unit", "key")
    return materialize(dealt.select("unit", F.monotonically_increasing_id().alias("row"), "doc_id", "ids", "rare"), "units"), units


def steps(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """unit, ids, bounds of documents of up to STEP_WORDS words together; a longer document comes alone."""
    unit, group, size = None, [], 0
    whole = lambda: (unit, np.concatenate(group).astype(np.int64), np.concatenate([[0], np.cumsum([len(g) for g in group])]))
    for batch in batches:
        for own, raw in zip(batch.column("unit").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            ids = np.frombuffer(raw, kind)
            if group and (own != unit or size + len(ids) > STEP_WORDS):
                yield whole()
                group, size = [], 0
            unit, size = own, size + len(ids)
            group.append(ids)
    if group:
        yield whole()


def _averaged(copies: DataFrame, group, groups: int) -> DataFrame:
    """Copies (slice, n, copy, values) averaged by slice and `group`, weighted by n; a running sum, one copy in memory."""

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        for batch in batches:
            for i, n, copy, values in zip(*batch.columns, strict=True):
                own = total.setdefault((i.as_py(), copy.as_py()), [0.0, 0.0])
                own[0] += n.as_py()
                own[1] = own[1] + n.as_py() * np.frombuffer(values.as_buffer(), np.float32).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([float(n) for n, _ in total.values()], pa.float64()), pa.array([k[1] for k in total], pa.int32()), pa.array([(v / n).astype(np.float32).tobytes() for n, v in total.values()], pa.binary())], ["slice", "n", "copy", "values"])

    dealt = copies.withColumn("copy", group.cast("int")).repartitionById(SLICES * groups, F.col("slice") * groups + F.col("copy"))
    return dealt.mapInArrow(lean(average), copies.schema)


def train(coded: DataFrame, units: int, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Network:
    """`rounds` rounds; round r reads the units u with u = r modulo the number of rounds (of units, if fewer). Without any word the network stays as it began."""
    network, context = Network(vocabulary), coded.sparkSession.sparkContext
    squares, kind, parts = np.zeros_like(network.flat), np.uint16 if vocabulary.n_ids < 1 << 16 else np.int32, min(rounds, units)
    dealt = coded.select("unit", "ids").filter(F.length("ids") > 0)
    for r in range(rounds):
        start = context.broadcast((vocabulary, network.flat, squares))  # some MB, whatever the corpus

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            def out() -> pa.RecordBatch:
                cut = np.array_split(np.stack([local.flat, sums]), SLICES, axis=1)
                return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([float(seen)] * SLICES), pa.array([own] * SLICES, pa.int32()), pa.array([p.tobytes() for p in cut], pa.binary())], ["slice", "n", "copy", "values"])

            own = None
            for unit, ids, bounds in steps(batches, kind):
                if unit != own:
                    if own is not None:
                        yield out()
                    own, local, sums, seen = unit, Network(start.value[0], start.value[1]), start.value[2].copy(), 0
                local.learn(ids, bounds, sums)
                seen += len(ids)
            if own is not None:
                yield out()

        copies = dealt.filter(F.col("unit") % parts == r % parts).mapInArrow(lean(run), "slice int, n double, copy int, values binary")
        groups = -(-units // parts // FAN_IN)
        if groups > 1:
            copies = _averaged(copies, F.col("copy") % groups, groups)
        merged = _averaged(copies, F.lit(0), 1).collect()  # one copy of the parameters
        if merged:
            both = np.concatenate([np.frombuffer(m["values"], np.float32).reshape(2, -1) for m in sorted(merged, key=lambda m: m["slice"])], axis=1)
            network, squares = Network(vocabulary, both[0]), both[1].copy()
        start.unpersist()
    return network


def score_coded(coded: DataFrame, network: Network, counts: DataFrame | None = None) -> DataFrame:
    """score, of rows that encode made."""
    shared = coded.sparkSession.sparkContext.broadcast(network)
    kind = np.uint16 if network.vocabulary.n_ids < 1 << 16 else np.int32
    alone = np.zeros(network.vocabulary.n_ids)
    if counts is not None:
        alone[network.vocabulary.buckets] = network.vocabulary.mass[network.vocabulary.buckets]  # the logs of the words' counts come from the join

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("ids").to_pylist()
            at, first = 0, 0
            while first < len(raw):
                last, size = first, 0
                while last < len(raw) and (last == first or size + len(raw[last]) <= CHUNK):
                    size += len(raw[last])
                    last += 1
                ids = np.frombuffer(b"".join(raw[first:last]), kind).astype(np.int64)
                n = np.array([len(x) // np.dtype(kind).itemsize for x in raw[first:last]], np.int64)
                bounds = np.concatenate([[0], np.cumsum(n)])
                each = shared.value.log_probabilities(ids, bounds) - alone[ids]
                sums = np.bincount(words.row_of(bounds), each, len(n)) if len(ids) else np.zeros(len(n))
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(n), pa.array(sums)], ["row", "doc_id", "n_words", "log_prob"])
                at, first = at + len(ids), last

    scored = coded.select("row", "doc_id", "ids").mapInArrow(lean(run), "row bigint, doc_id bigint, n_words bigint, log_prob double")
    if counts is not None:
        own = coded.select("row", F.explode("rare").alias("hash")).join(counts.filter("n > 1"), "hash")  # the log of 1 is 0
        own = own.groupBy("row").agg(F.sum(F.log("n")).alias("own"))
        scored = scored.join(own, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("own", F.lit(0.0)))
    return scored.select("doc_id", "n_words", "log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).alias("mean_log_prob"))


#: Bytes of ids that are scored at once.
CHUNK = 1 << 18


def score(docs: DataFrame, network: Network, counts: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, log_prob (natural), mean_log_prob of every row; a text without words (null, empty) has 0 and null.

    With counts (count_words of the corpus) a word of a bucket has the bucket's
    probability times its own share of the bucket, a word that the corpus lacks
    as if it were there once; without, it has that of the bucket. Repeated rows
    and rows without doc_id are scored each by itself.
    """
    return score_coded(encode(docs, network.vocabulary)[0], network, counts)
