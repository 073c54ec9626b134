"""Encoding of text batches with a public tokenizer file.

A byte-level BPE encodes each piece of its pre-tokenizer alone, so each
distinct piece is encoded once by the library and looked up after that, by its
bytes: pieces of up to 15 bytes are compared as two integers that hold their
bytes and length, longer ones as byte strings. Pieces are found with numpy for
texts of plain characters (below U+0280); any other text, and any text holding
an added token, is handed to the library as it is.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np

from . import words

LETTER, NUMBER, SPACE, OTHER, LIBRARY = 0, 1, 2, 3, 4
#: Pieces kept for look-up; beyond that the store starts again, which costs time only.
MAX_PIECES = 1_500_000
#: Slots of the direct-mapped table in front of the store.
FRONT_BITS = 18
#: Bytes of a piece that fit two integers together with its length.
SHORT = 15


def _class(c: int) -> int:
    kind = unicodedata.category(chr(c))
    if c in (9, 10, 13, 32):
        return SPACE
    if c in (11, 12, 0x85, 0xA0) or 0x1C <= c <= 0x1F:
        return LIBRARY
    return LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else OTHER


_ONE = np.array([_class(c) for c in range(128)] + [LIBRARY] * 128, np.uint8)
_TWO = np.array([_class(c) if c >= 128 else LIBRARY for c in range(0x280)], np.uint8)


class Encoder:
    """Token ids of texts; keeps the ids of the pieces it has met."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        before = json.loads(self.library.pre_tokenizer.__getstate__()) if self.library.pre_tokenizer is not None else {}
        model = self.library.model
        self.by_piece = type(model).__name__ == "BPE" and self.library.normalizer is None and before.get("type") == "ByteLevel" and bool(before.get("use_regex")) and not before.get("add_prefix_space") and not model.dropout
        self.added = [x.content.encode() for x in self.library.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        # index into begin and size: of short pieces, by sorted scrambles of their two integers; of long ones, by their bytes
        self.keys, self.pair, self.at = np.empty(0, np.uint64), np.empty((2, 0), np.uint64), np.empty(0, np.int32)
        self.long: dict[bytes, int] = {}
        self.begin, self.size, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.front = np.zeros((2, 1 << FRONT_BITS), np.uint64)
        self.front_place = np.zeros(1 << FRONT_BITS, np.int32)

    def encode_text(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all pieces, and which rows go to the library."""
        kind = _ONE[data]
        lead = np.flatnonzero((data >= 0xC2) & (data < 0xCA))
        if len(lead):
            two = _TWO[((data[lead].astype(np.int64) & 0x1F) << 6) | (data[lead + 1] & 0x3F)]
            kind[lead], kind[lead + 1] = two, two
        first = np.zeros(len(data) + 1, bool)
        first[1:-1] = kind[1:] != kind[:-1]
        first[offsets] = True
        # white space: the last of it before more text begins a piece, if a blank together with what follows
        ends = np.flatnonzero(first[1:] & (kind == SPACE))  # last byte of each run
        row_end = np.zeros(len(data) + 1, bool)
        row_end[offsets] = True
        ends = ends[~row_end[ends + 1]]
        first[ends] = True
        first[ends[data[ends] == 32] + 1] = False
        # contractions: an apostrophe that is a piece by itself takes the letters after it
        quote = np.flatnonzero((data == 39) & first[:-1] & first[1:])
        quote = quote[(quote + 1 < len(data))]
        quote = quote[(kind[quote + 1] == LETTER) & ~row_end[quote + 1]]
        if len(quote):
            one = data[quote + 1]
            second = np.where(quote + 2 < len(data), data[np.minimum(quote + 2, len(data) - 1)], 0)
            inside = ~row_end[np.minimum(quote + 2, len(data))]
            short = np.isin(one, list(b"stmd"))
            long = inside & (((one == 114) & (second == 101)) | ((one == 118) & (second == 101)) | ((one == 108) & (second == 108)))
            for at, n in ((quote[short], 1), (quote[long & ~short], 2)):
                first[at + 1] = False
                first[at + 1 + n] = True
        flagged = np.flatnonzero(kind == LIBRARY)
        rows = np.zeros(len(offsets) - 1, bool)
        rows[np.searchsorted(offsets, flagged, "right") - 1] = True
        whole = data.tobytes()
        for token in self.added:
            at = whole.find(token)
            while at >= 0:
                rows[np.searchsorted(offsets, at, "right") - 1] = True
                at = whole.find(token, at + 1)
        first[-1] = False
        return np.flatnonzero(first), rows

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Encode pieces not met before; returns their places. Those of a blank and ASCII letters are joined, so that one call encodes many."""
        plain = np.array([len(p) > 1 and p[0] == 32 and p[1:].isalpha() for p in pieces])
        joined, rest = np.flatnonzero(plain).tolist(), np.flatnonzero(~plain).tolist()
        got = self.library.encode_batch_fast([b"".join([pieces[i] for i in joined[k : k + 256]]).decode() for k in range(0, len(joined), 256)], add_special_tokens=False)
        flat = np.array([x for y in got for x in y.ids], np.int32)
        last = np.searchsorted(np.cumsum(self._sizes[flat]), np.cumsum([len(pieces[i]) for i in joined])) + 1  # no id crosses from one piece to the next
        alone = [x.ids for x in self.library.encode_batch_fast([pieces[i].decode() for i in rest], add_special_tokens=False)]
        size = np.concatenate([np.diff(last, prepend=0), np.fromiter(map(len, alone), np.int64, len(alone))]).astype(np.int64)
        places = np.empty(len(pieces), np.int64)
        places[joined + rest] = np.arange(len(self.begin), len(self.begin) + len(size))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat, np.array([x for y in alone for x in y], np.int32)])
        return places

    def _look_up_short(self, head: np.ndarray, tail: np.ndarray, pieces) -> np.ndarray:
        """Places of distinct short pieces; `pieces` gives the bytes of some. Both integers are compared, so a shared key costs time only."""
        key = words.mix(head ^ words.mix(tail))
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        places = np.full(len(key), -1)
        if len(self.keys):
            known = (self.pair[0][at] == head) & (self.pair[1][at] == tail)
            places[known] = self.at[at[known]]
        new = np.flatnonzero(places < 0)
        if len(new):
            places[new] = self._learn(pieces(new))
            new = new[np.argsort(key[new])]
            at = np.searchsorted(self.keys, key[new])
            self.keys, self.at = np.insert(self.keys, at, key[new]), np.insert(self.at, at, places[new])
            self.pair = np.insert(self.pair, at, np.stack([head[new], tail[new]]), axis=1)
        return places

    def _look_up_long(self, pieces: list[bytes]) -> np.ndarray:
        new = list(dict.fromkeys(p for p in pieces if p not in self.long))
        if new:
            self.long.update(zip(new, self._learn(new).tolist(), strict=True))
        return np.fromiter(map(self.long.__getitem__, pieces), np.int64, len(pieces))

    @property
    def _sizes(self) -> np.ndarray:
        """Bytes of each id's piece (one symbol of the byte-level alphabet a byte)."""
        if not hasattr(self, "_size_of"):
            vocab = self.library.get_vocab()
            self._size_of = np.zeros(max(vocab.values()) + 1, np.int64)
            for token, i in vocab.items():
                self._size_of[i] = len(token)
        return self._size_of

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and where each row begins (one entry more than rows)."""
        n = len(offsets) - 1
        if self.by_piece and len(data):
            starts, by_library = self._pieces(data, offsets)
        else:
            starts, by_library = np.empty(0, np.int64), np.diff(offsets) > 0
        bounds = np.searchsorted(starts, offsets)
        rows = words.row_of(bounds)
        ends = np.append(starts[1:], len(data))
        keep = ~by_library[rows] if len(rows) else np.empty(0, bool)
        starts, ends, rows = starts[keep], ends[keep], rows[keep]
        which = np.empty(len(starts), np.int64)
        if len(starts):
            if len(self.begin) > MAX_PIECES:
                self._clear()
            view, whole, length = words.lanes(data), data.tobytes(), ends - starts
            piece = lambda at: [whole[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            short = np.flatnonzero(length <= SHORT)
            head = view[starts[short]] & words.FIRST[np.minimum(length[short], 8)]
            tail = view[np.minimum(starts[short] + 8, len(data))] & words.FIRST[np.maximum(length[short] - 8, 0)] | length[short].astype(np.uint64) << np.uint64(56)
            slot = (words.mix(head ^ words.mix(tail)) >> np.uint64(64 - FRONT_BITS)).astype(np.int64)
            found = self.front_place[slot].astype(np.int64)
            missed = np.flatnonzero((self.front[0][slot] != head) | (self.front[1][slot] != tail))
            if len(missed):
                order = missed[np.lexsort((tail[missed], head[missed]))]
                first = np.ones(len(order), bool)
                first[1:] = (head[order][1:] != head[order][:-1]) | (tail[order][1:] != tail[order][:-1])
                one = order[first]
                known = self._look_up_short(head[one], tail[one], lambda new: piece(short[one[new]]))
                found[order] = known[np.cumsum(first) - 1]
                self.front[0][slot[one]], self.front[1][slot[one]], self.front_place[slot[one]] = head[one], tail[one], known
            which[short] = found
            long = np.flatnonzero(length > SHORT)
            which[long] = self._look_up_long(piece(long))
        begin, size, flat, extra = self.begin, self.size, self.flat, []
        for row in np.flatnonzero(by_library).tolist():
            extra.append((row, self.encode_text(data[offsets[row] : offsets[row + 1]].tobytes().decode())))
        if end_id is not None:
            extra += [(row, [end_id]) for row in range(n)] if extra else []
        if extra:
            begin = np.concatenate([begin, len(flat) + np.cumsum([0, *[len(x) for _, x in extra[:-1]]])])
            size = np.concatenate([size, [len(x) for _, x in extra]])
            flat = np.concatenate([flat, np.array([x for _, y in extra for x in y], np.int32)])
            rows = np.concatenate([rows, [r for r, _ in extra]])
            which = np.concatenate([which, len(self.begin) + np.arange(len(extra))])
        elif end_id is not None:
            begin, size, flat = np.append(begin, len(flat)), np.append(size, 1), np.append(flat, np.int32(end_id))
            rows = np.concatenate([rows, np.arange(n)])
            which = np.concatenate([which, np.full(n, len(self.begin))])
        if extra or end_id is not None:
            order = np.argsort(rows, kind="stable")
            rows, which = rows[order], which[order]
        sizes = size[which]
        total = np.cumsum(sizes)
        shift = np.repeat(begin[which] - (total - sizes), sizes)
        ids = flat[shift + np.arange(len(shift))] if len(shift) else np.empty(0, np.int32)
        per_row = np.bincount(rows, sizes, n).astype(np.int64) if len(rows) else np.zeros(n, np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_row)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One a process; a Python worker keeps it from task to task."""
    return Encoder(path)
