"""Benchmark decontamination with a suffix automaton of all test items.

The automaton holds every run of words of every item. A document's words are
streamed through it, which gives at each word the longest run ending there that
occurs in some item. Only stretches whose neighbouring words are neighbours in
some item can hold a match of two words or more; numpy finds those stretches
and the automaton walks them alone, which loses nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import chunked_array, lean, materialize, text_chunks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Text of the items of one automaton, about; it takes some 70 bytes for each of theirs, on the driver and in every worker.
GROUP_BYTES = 4 << 20


class Automaton:
    """Suffix automaton of several word sequences (a state for each class of runs with the same end places)."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocabulary: dict[str, int] = {}
        sequences = []
        for item, text in items:
            found = WORD.findall((text or "").translate(LOWER))
            if found:
                sequences.append((item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found]))
        for _, sequence in sequences:
            last = 0
            for c in sequence:
                last = self._extend(last, c)
        #: window size -> state of a window -> items that hold it
        self.owners: dict[int, dict[int, set]] = {}
        pairs = set()
        for item, sequence in sequences:
            size = min(window, len(sequence))
            own = self.owners.setdefault(size, {})
            state = matched = 0
            for i, c in enumerate(sequence):
                state, matched = self.step_within(state, matched, c, size)
                if i + 1 >= size:
                    own.setdefault(state, set()).add(item)
                if i:
                    pairs.add((sequence[i - 1] << 32) | c)
        self.pairs = np.array(sorted(pairs), np.int64)
        encoded = [w.encode() for w in self.vocabulary]
        at = np.cumsum([0, *map(len, encoded)])
        hashed = words.hashes(np.frombuffer(b"".join(encoded), np.uint8), at[:-1], at[1:]) if encoded else np.empty(0, np.uint64)
        self.order = np.argsort(hashed)
        self.hashed = hashed[self.order]

    def _extend(self, last: int, c: int) -> int:
        to = self.next[last].get(c)
        if to is not None:
            return to if self.length[to] == self.length[last] + 1 else self._clone(last, c, to)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and c not in self.next[last]:
            self.next[last][c] = new
            last = self.link[last]
        if last >= 0:
            to = self.next[last][c]
            self.link[new] = to if self.length[to] == self.length[last] + 1 else self._clone(last, c, to)
        return new

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, at: int, c: int, of: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.next[of]), self.link[of])
        self.link[of] = copy
        while at >= 0 and self.next[at].get(c) == of:
            self.next[at][c] = copy
            at = self.link[at]
        return copy

    def step(self, state: int, matched: int, c: int) -> tuple[int, int]:
        """The longest match after one more word."""
        while state and c not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        to = self.next[state].get(c)
        return (0, 0) if to is None else (to, matched + 1)

    def step_within(self, state: int, matched: int, c: int, size: int) -> tuple[int, int]:
        """The same for a match of `size` words at most: a longer one loses its first word, which is one link up at most."""
        state, matched = self.step(state, matched, c)
        if matched > size:
            matched = size
            if self.length[self.link[state]] >= size:
                state = self.link[state]
        return state, matched

    def stream(self, sequence: list[int]) -> tuple[np.ndarray, set, int]:
        """For consecutive word ids: which words are inside an item's window, the items, the longest match."""
        hit, items, longest, state, matched = np.zeros(len(sequence), bool), set(), 0, 0, 0
        within = dict.fromkeys(self.owners, (0, 0))
        for i, c in enumerate(sequence):
            state, matched = self.step(state, matched, c)
            longest = max(longest, matched)
            for size, own in self.owners.items():
                at, n = within[size] = self.step_within(*within[size], c, size)
                if n == size and (found := own.get(at)):
                    hit[i + 1 - size : i + 1] = True
                    items |= found
        return hit, items, longest

    def stretches(self, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last word of every stretch that can hold a window."""
        if not self.owners or not len(ids):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        least = min(self.owners)
        if least < 2:
            known = ids >= 0
            first = known & np.concatenate([[True], ~known[:-1] | (rows[1:] != rows[:-1])])
            last = known & np.concatenate([~known[1:] | (rows[1:] != rows[:-1]), [True]])
            return np.flatnonzero(first), np.flatnonzero(last) + 1
        both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & (rows[:-1] == rows[1:]))
        key = (ids[both].astype(np.int64) << 32) | ids[both + 1]
        at = np.minimum(np.searchsorted(self.pairs, key), max(0, len(self.pairs) - 1))
        linked = np.zeros(len(ids) + 1, bool)  # linked[i]: word i-1 and word i are neighbours in an item
        linked[both[self.pairs[at] == key] + 1] = True
        edge = np.diff(linked.astype(np.int8), prepend=0)
        begin, end = np.flatnonzero(edge == 1) - 1, np.flatnonzero(edge == -1)
        long = end - begin >= least
        return begin[long], end[long]

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, set], dict[int, int]]:
        """Word starts and ends, bounds of rows in them, hit words, items and longest match of each row that has any."""
        starts, ends, bounds = words.spans(data, offsets)
        hit, items, longest = np.zeros(len(starts), bool), {}, {}
        if len(starts) and len(self.hashed):
            hashed = words.hashes(data, starts, ends)
            at = np.minimum(np.searchsorted(self.hashed, hashed), len(self.hashed) - 1)
            ids = np.where(self.hashed[at] == hashed, self.order[at], -1)
            rows = words.row_of(bounds)
            for a, b in zip(*self.stretches(ids, rows), strict=True):
                texts = [data[s:e].tobytes().decode().translate(LOWER) for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                inside, found, length = self.stream([self.vocabulary.get(w, -1) for w in texts])
                row = int(rows[a])
                longest[row] = max(longest.get(row, 0), length)
                if found:
                    hit[a:b] |= inside
                    items.setdefault(row, set()).update(found)
        return starts, ends, bounds, hit, items, longest


def groups_of(benchmark: DataFrame, group_bytes: int = GROUP_BYTES) -> int:
    """How many automata a benchmark table (item_id, text) takes: items are dealt by a hash into groups of about group_bytes."""
    size = benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(1, -(-size // group_bytes))


def build(benchmark: DataFrame, window: int, groups: int = 1, group: int = 0) -> Automaton:
    """The automaton of a group of items."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter(F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(groups)) == group)
    return Automaton(sorted(((r[0], r[1]) for r in items.collect()), key=lambda r: (str(r[0]), r[1] or "")), window)


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _match(rows: DataFrame, automaton: Automaton, everything: bool) -> DataFrame:
    """rows with n_words, items, spans, longest for their text; without `everything` only those with a match."""
    shared = rows.sparkSession.sparkContext.broadcast(automaton)
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_chunks(batches):
            _, _, bounds, hit, items, longest = shared.value.scan(data, offsets)
            n = len(batch)
            names = [sorted("null" if i is None else str(i) for i in items[r]) if r in items else [] for r in range(n)]
            spans = [[{"first": a, "last": b} for a, b in _spans(hit[bounds[r] : bounds[r + 1]])] if r in items else [] for r in range(n)]
            made = [pa.array(np.diff(bounds)), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.array([longest.get(r, 0) for r in range(n)], pa.int32())]
            out = pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + made, [f.name for f in kept] + ["n_words", "items", "spans", "longest"])
            yield out if everything else out.filter(pa.array([bool(x) or longest.get(r, 0) > 0 for r, x in enumerate(names)]))

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "n_words bigint, items array<string>, spans array<struct<first:int,last:int>>, longest int"])
    return rows.mapInArrow(lean(match), schema)


def _n_hit(spans):
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda acc, s: acc + s["last"] - s["first"])


def _united(spans):
    """Sorted spans of several groups, overlapping and touching ones as one."""
    start = F.struct(F.array().cast("array<struct<first:int,last:int>>").alias("done"), F.lit(None).cast("struct<first:int,last:int>").alias("open"))
    step = lambda acc, s: (
        F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), s.alias("open")))
        .when(s["first"] <= acc["open"]["last"], F.struct(acc["done"].alias("done"), F.struct(acc["open"]["first"].alias("first"), F.greatest(acc["open"]["last"], s["last"]).alias("last")).alias("open")))
        .otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), s.alias("open")))
    )
    return F.aggregate(F.sort_array(spans), start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def _match_groups(rows: DataFrame, benchmark: DataFrame, window: int, groups: int) -> DataFrame:
    """row, items, spans, longest of the rows (row, text) with a match, from one pass for each group of items."""
    found = None
    for g in range(groups):
        own = materialize(_match(rows, build(benchmark, window, groups, g), everything=False).drop("n_words"), "matches")
        found = own if found is None else found.unionByName(own)
    united = found.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"), F.max("longest").alias("longest"))
    return united.withColumn("spans", _united(F.col("spans")))


def match_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items array<string>, spans array<struct<first, last>> (words, last not included), longest.

    A window is `window` consecutive words of an item, or all of a shorter one.
    A row for every row of docs; null text has no words; null item ids count as
    the id "null"; items are distinct ids in the order of strings. A benchmark
    of more than group_bytes is matched group by group, in one pass over docs
    for each, and hits are united by row.
    """
    groups = groups_of(benchmark, group_bytes)
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    if groups == 1:
        matched = _match(texts, build(benchmark, window), everything=True)
    else:
        rows = materialize(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
        none = Automaton([], window)
        found = _match_groups(rows.select("row", "text"), benchmark, window, groups)
        matched = _match(rows, none, everything=True).select("row", "doc_id", "n_words").join(found, "row", "left")
        matched = matched.withColumns({"items": F.coalesce("items", F.array().cast("array<string>")), "spans": F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>")), "longest": F.coalesce("longest", F.lit(0))})
    return matched.select("doc_id", "n_words", _n_hit(F.col("spans")).alias("n_hit"), "items", "spans", "longest")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _without(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> bytes:
    """The text without the spans of words and what stands between their words."""
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at : starts[a]].tobytes())
        at = ends[b - 1]
    return b"".join([*parts, raw[at:].tobytes()])


def _with_text(docs: DataFrame, touched, text) -> DataFrame:
    """docs with a new text, and n_chars after it, where touched."""
    kinds = {f.name: f.dataType for f in docs.schema}
    new = {"text": F.when(touched, text.cast(kinds["text"])).otherwise(F.col("text"))}
    if "n_chars" in kinds:
        new["n_chars"] = F.when(touched, F.char_length(text).cast(kinds["n_chars"])).otherwise(F.col("n_chars"))
    return docs.withColumns(new)


def _remove_by_groups(docs: DataFrame, benchmark: DataFrame, window: int, max_coverage: float, groups: int) -> DataFrame:
    """remove_spans for a benchmark of several automata: all groups' spans are found, united and cut, until none are found."""

    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            out = []
            for text, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                starts, ends, _ = words.spans(raw, np.array([0, len(raw)]))
                out.append(_without(raw, starts, ends, [(s["first"], s["last"]) for s in own]).decode())
            yield pa.array(out, pa.string())

    names, first = docs.columns, True
    docs = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "docs")
    while True:
        found = _match_groups(docs.select(F.col("_row").alias("row"), F.col("text").cast("string").alias("text")), benchmark, window, groups).filter(F.size("spans") > 0)
        found = materialize(found.select(F.col("row").alias("_row"), F.col("spans").alias("_spans")), "spans")
        if found.isEmpty():
            return docs.select(*names)
        hit = docs.join(found, "_row")
        if first:
            hit = hit.filter(_n_hit(F.col("_spans")) <= F.lit(max_coverage) * F.regexp_count(F.col("text").cast("string"), F.lit(WORD.pattern)))
        first = False
        new = F.arrow_udf(cut, "string")(F.col("text").cast("string"), F.col("_spans"))
        cleaned = _with_text(hit.withColumn("_new", new), F.lit(True), F.col("_new")).select(*names, "_row")
        docs = materialize(docs.join(found, "_row", "left_anti").select(*names, "_row").unionByName(cleaned), "docs")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.8, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """docs without benchmark passages; all columns stay.

    Every span of words inside an item's window is cut out of the text, with
    what stands between them; what comes together is scanned again until
    nothing is found. A document of whose words more than `max_coverage` are
    inside windows is dropped. Where there is an n_chars column it follows the
    new text. Untouched rows, nulls included, stay as they are. Only texts go to
    Python, and only those that change come back. A benchmark of more than
    group_bytes is matched group by group.
    """
    groups = groups_of(benchmark, group_bytes)
    if groups > 1:
        return _remove_by_groups(docs, benchmark, window, max_coverage, groups)
    shared = docs.sparkSession.sparkContext.broadcast(build(benchmark, window))

    def clean(text: str, automaton: Automaton) -> str | None:
        first = True
        while True:
            raw = np.frombuffer(text.encode(), np.uint8)
            starts, ends, _, hit, items, _ = automaton.scan(raw, np.array([0, len(raw)]))
            if not items:
                return text
            if first and hit.sum() > max_coverage * len(hit):
                return None
            first = False
            text = _without(raw, starts, ends, _spans(hit)).decode()

    def remove(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = shared.value

        def kernel(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
            n = len(offsets) - 1
            touched, text = np.zeros(n, bool), [None] * n
            for row in automaton.scan(data, offsets)[4]:
                touched[row], text[row] = True, clean(data[offsets[row] : offsets[row + 1]].tobytes().decode(), automaton)
            return pa.StructArray.from_arrays([pa.array(touched), pa.array(text, pa.string())], ["touched", "text"])

        yield from chunked_array(texts, kernel)

    # not deterministic: else the filter below would be pushed down with a copy of the function
    cut = F.arrow_udf(remove, "touched boolean, text string").asNondeterministic()
    made = docs.withColumn("_cut", cut(F.col("text").cast("string"))).filter("not _cut.touched or _cut.text is not null")
    return _with_text(made, F.col("_cut.touched"), F.col("_cut.text")).select(*docs.columns)
