"""Near duplicates with DartMinHash signatures, a banded join and an exact check.

A document is the bag of its five-word shingles; similarity is weighted
Jaccard, sum of min over sum of max of the shingles' counts. A shingle of
weight w owns the region [0, w) of the weight axis. Darts fall into weight x
rank space as a Poisson process that is a function of the shingle alone, each
aimed at one coordinate of the signature; of the darts inside a document's
regions each coordinate keeps the one of the lowest rank. Two documents agree
in a coordinate with a probability equal to their similarity.

Documents that share a band of coordinates are linked to the band's least
document; the components of those links hold every pair that shares a band.
Inside a component similarities are then computed exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import fresh, lean, materialize, text_chunks
from .components import components, join_facts

SHINGLE = 5
THRESHOLD = 0.8
#: A pair at the threshold shares no band with probability (1 - 0.8**7)**48, about 1e-5.
BANDS, ROWS = 48, 7
#: Shingles of a component that one task compares; larger ones are compared in pairs of blocks.
BLOCK_SHINGLES = 2_000_000
#: Text that is sketched at once; its darts take some hundred times as much.
SKETCH_BYTES = 1 << 18
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def bag(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, counts and rows of a text chunk, rows ascending."""
    starts, ends, bounds = words.spans(data, offsets)
    hashed, rows = words.shingles(words.hashes(data, starts, ends), bounds, size)
    order = np.lexsort((hashed, rows))
    hashed, rows = hashed[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    return hashed[first], np.diff(np.append(first, len(rows))), rows[first]


def unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] of 64-bit hashes."""
    return ((x >> _U(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(element: np.ndarray, weight: np.ndarray, row: np.ndarray, n_rows: int, k: int, seed: int = 1) -> np.ndarray:
    """(n_rows, k) hashes of the earliest darts; rows without weight are 0.

    A region of weight w is cut into cells of weight one (the last one in
    part). In each cell darts arrive in rank order at rate one; one beyond the
    region's edge misses. Only ranks that a row is likely to need are thrown;
    rows with an empty coordinate throw again, twice as far.
    """
    cells = np.ceil(weight).astype(np.int64)
    of = np.repeat(np.arange(len(element)), cells)
    layer = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
    cell = words.mix(element[of] + _GOLD * (layer.astype(_U) + _U(seed)))
    inside = (weight[of] - layer).astype(np.float64)  # weight of the region inside the cell, 1 or more: all
    home, parts = row[of], bool((inside < 1).any())
    total = np.bincount(row, weight, n_rows)
    reach = np.divide(k * (np.log(k) + 3), total, out=np.zeros(n_rows), where=total > 0)
    best, found = np.full(n_rows * k, np.inf), np.zeros(n_rows * k, _U)
    todo = total > 0
    while todo.any():
        live = np.flatnonzero(todo[home])
        at, state, rank = live, cell[live], np.zeros(len(live))
        slots, ranks, darts = [], [], []
        while len(at):
            state = words.mix(state + _GOLD)  # high bits: the time to the next dart; low bits: its coordinate
            rank = rank - np.log(unit(state))
            hit = rank < reach[home[at]]
            at, state, rank = at[hit], state[hit], rank[hit]
            slot, r, dart = home[at] * k + ((state & _U(0xFFFFFFFF)) * _U(k) >> _U(32)).astype(np.int64), rank, state
            if parts:
                lands = unit(words.mix(state ^ _U(0xA5A5A5A5A5A5A5A5))) <= inside[at]
                slot, r, dart = slot[lands], r[lands], dart[lands]
            slots.append(slot)
            ranks.append(r)
            darts.append(dart)
        slot, r, dart = np.concatenate(slots), np.concatenate(ranks), np.concatenate(darts)
        np.minimum.at(best, slot, r)
        first = best[slot] == r
        found[slot[first]] = dart[first] | _U(1)  # never 0
        todo &= np.isinf(best.reshape(n_rows, k)).any(1)
        reach *= 2
    return found.reshape(n_rows, k)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band; keys of different bands differ."""
    out = np.zeros((len(signature), bands), _U)
    for i in range(rows):
        out = words.mix(out * _GOLD + signature[:, i * bands : (i + 1) * bands])
    return words.mix(out + np.arange(1, bands + 1, dtype=_U))


def exact_ids(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, 2): 128-bit BLAKE2 digests of each text's words in order, one blank between them; of the bytes, for a text without words."""
    _, ends, bounds = words.spans(data, offsets)
    low, keep = words.LOWER[data], words.IS_WORD[data]
    inner = np.ones(len(ends), bool)
    inner[bounds[1:][np.diff(bounds) > 0] - 1] = False  # a row's last word needs no blank
    keep[ends[inner]], low[ends[inner]] = True, 32
    at, plain = np.concatenate([[0], np.cumsum(keep)])[offsets].tolist(), low[keep].tobytes()
    digests = [hashlib.blake2b(plain[a:b], digest_size=16, person=b"words") if a < b else hashlib.blake2b(data[offsets[r] : offsets[r + 1]].tobytes(), digest_size=16, person=b"bytes") for r, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]
    return np.frombuffer(b"".join(d.digest() for d in digests), np.int64).reshape(-1, 2)


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, same_a, same_b (exact_ids), n_shingles, keys of each row.

    A text without words has no keys: it equals only the same text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_chunks(batches, limit=SKETCH_BYTES):
            n, same = len(batch), exact_ids(data, offsets)
            shingle, count, row = bag(data, offsets)
            keys = band_keys(signatures(shingle, count, row, n, bands * rows), bands, rows)
            some = np.bincount(row, minlength=n) > 0
            at = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(same[:, 0].copy()), pa.array(same[:, 1].copy()), pa.array(np.bincount(row, count, n).astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(keys[some].ravel().view(np.int64)))],
                ["doc_id", "same_a", "same_b", "n_shingles", "keys"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).filter("doc_id is not null").mapInArrow(lean(run), "doc_id bigint, same_a bigint, same_b bigint, n_shingles bigint, keys array<bigint>")


def similar_trees(element: np.ndarray, count: np.ndarray, row: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """For each of n bags, the first bag of its component in the graph of similarities >= threshold (exact).

    Breadth first: a bag taken from the queue is compared with all bags not
    reached yet, so a tight family costs little more than one pass.
    """
    size = np.bincount(row, count, n)
    layers = np.repeat(np.arange(len(element)), count)
    nth = np.arange(len(layers)) - np.repeat(np.cumsum(count) - count, count)
    cell = words.mix(element[layers] + _GOLD * (nth.astype(_U) + _U(1)))  # sum of min = cells in common
    of = row[layers]
    _, ids, seen = np.unique(cell, return_inverse=True, return_counts=True)
    shared = seen[ids] > 1
    ids, of = ids[shared], of[shared]
    mark = np.zeros(len(seen), bool)
    bounds = np.searchsorted(of, np.arange(n + 1))
    root = np.full(n, -1)
    rest, rest_ids, rest_at = np.arange(n), ids, bounds
    for seed in range(n):
        if root[seed] >= 0:
            continue
        root[seed] = seed
        queue = [seed]
        while queue:
            i = queue.pop()
            open_ = root[rest] < 0
            if open_.sum() < 0.7 * len(rest):
                keep = np.repeat(open_, np.diff(rest_at))
                rest_ids, sizes = rest_ids[keep], np.diff(rest_at)[open_]
                rest, rest_at = rest[open_], np.concatenate([[0], np.cumsum(sizes)])
                open_ = np.ones(len(rest), bool)
            if not len(rest):
                break
            own = ids[bounds[i] : bounds[i + 1]]
            mark[own] = True
            sums = np.concatenate([[0], np.cumsum(mark[rest_ids])])
            mark[own] = False
            both = sums[rest_at[1:]] - sums[rest_at[:-1]]
            near = rest[open_ & (both > 0) & (both >= threshold * (size[i] + size[rest] - both) - 1e-9)]
            root[near] = seed
            queue += near.tolist()
    return root


def _verified(rows: DataFrame, threshold: float) -> DataFrame:
    """a, b: for each document of a block (rows come sorted by component and block) the first one of its verified tree."""

    def edges(texts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(texts).combine_chunks()
        element, count, row, at = [], [], [], 0
        for batch, data, offsets in text_chunks(iter(table.to_batches())):
            e, c, r = bag(data, offsets)
            element.append(e)
            count.append(c)
            row.append(r + at)
            at += len(batch)
        root = similar_trees(np.concatenate(element), np.concatenate(count), np.concatenate(row), at, threshold)
        ids = table.column("doc_id").to_numpy()
        linked = root != np.arange(at)
        return pa.RecordBatch.from_arrays([pa.array(ids[linked], pa.int64()), pa.array(ids[root[linked]], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            group = batch.column("block_key").to_numpy()
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    if held and group[a] != last:
                        yield edges(held)
                        held = []
                    held.append(batch.slice(a, b - a).select(["doc_id", "text"]))
                    last = group[a]
        if held:
            yield edges(held)

    return rows.mapInArrow(lean(run), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, class_id of every row: the least doc_id among the documents that links of similarity >= threshold connect.

    Null and empty texts equal each other. Rows with one doc_id are one
    document. A row without doc_id gets no class (null).
    """
    seen = materialize(sketch(docs, bands, rows), "sketch")
    texts = seen.groupBy("same_a", "same_b").agg(F.min("doc_id").alias("rep"))
    texts = materialize(texts, "texts")
    copies = seen.join(texts, ["same_a", "same_b"]).filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    own = seen.join(texts, ["same_a", "same_b"]).filter("doc_id = rep").select("doc_id", F.explode("keys").alias("key"))
    heads = own.groupBy("key").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("head <> last").select("key", "head", "n")
    heads = materialize(heads, "heads")
    coarse = components(join_facts(own, heads, "key", texts.count() * bands).filter("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b")))
    members = coarse.unionByName(coarse.select(F.col("root").alias("node"), "root").distinct())
    sized = members.join(seen.select("doc_id", "n_shingles"), F.col("node") == F.col("doc_id"))
    totals = sized.groupBy("root").agg(F.sum("n_shingles").alias("total")).select("root", F.ceil(F.col("total") / block).cast("int").alias("blocks"))
    # one block: one group; more: every pair of blocks is a group, and a document is in as many as there are blocks
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("p"), F.greatest(o, F.col("mine")).alias("q")))
    dealt = members.join(totals, "root").withColumn("mine", mine).select("node", "root", F.explode(others).alias("pair"), "blocks").filter("blocks = 1 or pair.p <> pair.q")
    dealt = materialize(dealt.select(F.col("node").alias("doc_id"), F.xxhash64("root", "pair.p", "pair.q").alias("block_key")), "blocks")
    bodies = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    compared = dealt.join(bodies, "doc_id").repartition("block_key").sortWithinPartitions("block_key", "doc_id")
    links = _verified(compared.select("block_key", "doc_id", "text"), threshold)
    found = components(links.unionByName(copies))
    named = found.select(F.col("node").alias("doc_id"), "root")
    return docs.select(F.col("doc_id").cast("bigint")).join(named, "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose document is the first of its class, all columns; rows without doc_id stay.

    Of several rows with one doc_id all stay.
    """
    gone = fresh(docs, "gone")
    classes = near_duplicates(docs, **options).filter("doc_id <> class_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(classes, F.col("doc_id").cast("bigint") == F.col(gone), "left_anti")
