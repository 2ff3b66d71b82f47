"""Splitting text into the pieces that byte-level BPE vocabularies are applied to, without a loop over pieces.

The pieces are those of the published pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

found from the classes of neighbouring characters. Texts are taken a block at a
time; a piece is encoded once for all its occurrences in a stretch of the partition.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .common import blocks, ragged, release, span_hashes

SPACE, LETTER, NUMBER, OTHER = range(4)
_CLASS: list[np.ndarray] = []
#: Bytes of text whose pieces are encoded together.
STRETCH = 12_000_000


def classes() -> np.ndarray:
    if not _CLASS:
        table = np.full(0x110000, OTHER, np.uint8)
        for i in range(0x110000):
            kind = unicodedata.category(chr(i))[0]
            if kind in "LN":
                table[i] = LETTER if kind == "L" else NUMBER
        table[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
        _CLASS.append(table)
    return _CLASS[0]


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, first code point of each piece, its byte position, first piece of each document and the total)."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = (data & 0xC0) != 0x80
    place = np.flatnonzero(lead)
    bound = np.r_[0, np.cumsum(lead)][offsets]  # documents in code points
    n = len(points)
    if not n:
        none = np.zeros(0, np.int64)
        return points, none, none, np.zeros(len(offsets), np.int64)
    c = classes()[points]
    opens = np.zeros(n + 4, bool)  # first of a document; true past the end
    opens[bound] = True
    opens[n:] = True
    space = c == SPACE
    start = opens[: n + 1].copy()
    begin = start[:n]
    before = np.r_[np.uint8(255), c[:-1]]
    blank_before = np.r_[False, points[:-1] == 32]
    next_solid = np.r_[~space[1:], False] & ~opens[1 : n + 1]
    begin |= np.where(space, (before != SPACE) | next_solid, (before != c) & ~blank_before)
    quotes = np.flatnonzero((points == 39) & begin)
    if len(quotes):
        wide = np.r_[points, np.zeros(3, np.uint32)]
        a, b = wide[quotes + 1], wide[quotes + 2]
        inside, inside2 = ~opens[quotes + 1], ~opens[quotes + 1] & ~opens[quotes + 2]
        one = inside & np.isin(a, [ord(x) for x in "stmd"])
        two = inside2 & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for hit, size in ((one, 1), (two, 2)):
            q = quotes[hit]
            start[q + 1] = False
            start[np.minimum(q + 1 + size, n)] = True
    first = np.flatnonzero(start[:n])
    return points, first, place[first], np.searchsorted(first, bound)


class _Stretch:
    def __init__(self) -> None:
        self.blocks: list[tuple] = []
        self.hashes: list[np.ndarray] = []
        self.text: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.bytes = 0

    def add(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        points, first, place, docs = split(data, offsets)
        end = np.r_[first[1:], len(points)].astype(np.int64)[: len(first)]
        h = span_hashes(points, first, end)
        unique, at, which = np.unique(h, return_index=True, return_inverse=True)
        sizes = np.r_[place[1:], len(data)].astype(np.int64)[: len(place)] - place
        self.blocks.append((ids, data, offsets, docs, which.astype(np.int32)))
        self.hashes.append(unique)
        self.text.append(data[ragged(place[at], sizes[at])])
        self.sizes.append(sizes[at])
        self.bytes += len(data)

    def flush(self, encode: Callable) -> Iterator[tuple]:
        if not self.blocks:
            return
        unique, at, which = np.unique(np.concatenate(self.hashes), return_index=True, return_inverse=True)
        sizes, text = np.concatenate(self.sizes), np.concatenate(self.text)
        begin = np.cumsum(sizes) - sizes
        ids, id_offsets = encode(text[ragged(begin[at], sizes[at])], np.r_[0, np.cumsum(sizes[at])])
        counts, taken = np.diff(id_offsets), 0
        for (doc_ids, data, offsets, docs, local), uniques in zip(self.blocks, self.hashes):
            piece = which[taken : taken + len(uniques)][local]
            taken += len(uniques)
            many = counts[piece]
            yield doc_ids, data, offsets, ids[ragged(id_offsets[piece], many)], np.r_[0, np.cumsum(many)][docs]
        self.__init__()


def encoded(batches: Iterator[pa.RecordBatch], encode: Callable) -> Iterator[tuple]:
    """(doc ids, bytes, byte offsets, token ids, token offsets) of each block of (doc_id, text) batches.

    encode gets the distinct pieces of a stretch as (bytes, offsets) and returns (ids, offsets).
    """
    stretch = _Stretch()
    for batch in batches:
        for first, last, data, offsets in blocks(batch.column(1)):
            stretch.add(batch.column(0)[first:last], data, offsets)
            if stretch.bytes >= STRETCH:
                yield from stretch.flush(encode)
                release()
    yield from stretch.flush(encode)
    release()
