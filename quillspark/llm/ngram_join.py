"""Self-join of documents on the Jaccard similarity of their word n-grams, by vertical partitioning.

Sets of n-grams are cut along a global order of the n-grams into fragments, and each
fragment is worked on by itself:

1. Every set is split into segments by fragment (ranges of n-gram hashes). A fragment
   sees all occurrences of its n-grams, so it knows how many documents have each.
   Those that only one document has are dropped (they stay counted in the set's size).
   Put together again, a document whose remaining n-grams are fewer than threshold * size
   can have no partner and is dropped. Documents with the same set are represented by
   the one of least doc_id. The global order is (frequency class, hash), rare first. The
   sets are written as a table in buckets of doc_id, so that what follows doesn't shuffle it.
2. Cores: documents that agree in one of a few pairs of min-hashes of their rare n-grams are compared with the least among
   them, and those that are similar are put together. This only saves work and decides nothing.
3. Within a core, similar pairs are the rule, so all its pairs are counted: along the
   global order, fragment by fragment, partial overlaps are counted separately and summed
   for each pair. The sums stay in the task, which returns the number of links of each
   document; a large core is cut into parts, and parts meet in pairs.
4. Between cores, similar pairs are the exception. Of each set a prefix in the global order is
   posted; two similar sets share an n-gram in it. Fragments of the postings give the
   pairs of documents of different cores, filtered by size and position, which are compared exactly.

So every pair of different sets is either counted in 3 or found in 4: no link is lost, and no
number of partners is capped. N-grams are compared by a hash of 43 bits (40 in tiny tables): for a pair of documents
of a thousand words each, the chance that two different n-grams count as one is 1e-7.

Defined cases: words are runs of ASCII letters, digits and non-ASCII characters, ASCII
capitals as small letters; a text of fewer than n words has one n-gram, all its words; a
null text or one without words is a class of its own; a null doc_id, or one that is no whole number, is left out; of rows that
repeat a doc_id the one of least text counts; very long texts are sets like any other; similarities of
exactly the threshold are links; a class is named after its least doc_id; other columns are ignored, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, blocks, bucket_of, keep, lists, mix, ragged, release, whole, words
from .cores import classified, cores, leaders, placed

#: Pairs of words: a changed word costs a pair of texts only two n-grams, so copies with every tenth word changed, at 0.8/1.2, are still found.
N = 2
THRESHOLD = 0.6
#: n-grams in one fragment, about; those of the documents cut up together; and of a core's part.
MASS, CHUNK, PART = 3_000_000, 400_000, 1_000_000
#: Postings in a fragment of the prefixes; and of one n-gram, beyond which they are cut up.
POSTED, CROWD = 600_000, 4096
#: Bits by which fragments are told apart in one shuffle; more of them take another, so that the pieces of a chunk stay large.
LEVEL = 11
#: Buckets of the table of sets, in bits; Spark takes no more than 100,000.
BUCKETS = 16
#: Pairs of min-hashes of a document.
SKETCH = 5
#: Bits of a hash, of its key in a fragment, and of the frequency class before it in a code, which has six bytes.
_HASH, _KEY, _CLASSES = 43, 40, 31
_MASK = np.uint64((1 << _HASH) - 1)
_LOW = np.uint64((1 << _KEY) - 1)


def grams(data: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(document, 43-bit n-gram), sorted, each once."""
    h, doc, *_ = words(data, offsets)
    size = len(offsets) - 1
    count = np.bincount(doc, minlength=size)
    begin = np.cumsum(count) - count
    has = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    first = ragged(begin, has)
    owner = np.repeat(np.arange(size), has)
    last = np.minimum(first + n, (begin + count)[owner])
    g = np.zeros(len(first), np.uint64)
    for k in range(n):
        there = first + k < last
        g[there] = mix(g[there] * np.uint64(3) + h[first[there] + k] + np.uint64(k))
    g >>= np.uint64(64 - _HASH)
    order = np.argsort(g)
    order = order[np.argsort(owner[order].astype(np.uint16) if size < 1 << 16 else owner[order], kind="stable")]
    owner, g = owner[order], g[order]
    fresh = np.r_[True, (np.diff(owner) > 0) | (g[1:] != g[:-1])][: len(g)]
    return owner[fresh], g[fresh]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start, and their lengths."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return start, np.diff(np.r_[start, len(values)])


# Pieces of sets on their way: one row holds, for one part of a cut, what many documents have there.
PIECES = "part int, docs binary, sizes binary, counts binary, keys binary"
_NAMES = ["docs", "sizes", "counts", "keys"]


def _small(values: np.ndarray) -> bytes:
    """Whole numbers, as differences and compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(values.astype("<i8"), prepend=np.int64(0)).tobytes())


def _pieces(part: np.ndarray, ids: np.ndarray, sizes: np.ndarray, owner: np.ndarray, keys: np.ndarray, width: int) -> pa.RecordBatch:
    """ids, sizes: of documents; part, owner, keys: of n-grams, of whose keys the lowest bytes are stored, ``width`` of them."""
    order = np.lexsort((owner, part)) if len(part) and part.max() >= 1 << 16 else np.argsort(part.astype(np.uint16), kind="stable")
    part, keys, owner = part[order], keys[order], owner[order]
    out: list[list] = [[], [], [], [], []]
    for s, k in zip(*(x.tolist() for x in _runs(part))):
        own, count = _runs(owner[s : s + k])
        who = owner[s : s + k][own]
        for column, v in zip(out, (int(part[s]), _small(ids[who]), _small(sizes[who]), _small(count), _narrow(keys[s : s + k], width))):
            column.append(v)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["part", *_NAMES])


def _unpacked(rows: pa.Table | pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, sizes, owner, keys) of the rows, one after the other."""
    ids, sizes, counts = (_list(rows, c) for c in _NAMES[:3])
    return ids, sizes, np.repeat(np.arange(len(ids), dtype=np.int32), counts), _wide(b"".join(rows.column("keys").to_pylist()), width)


def _fragment(g: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(fragment of each n-gram, its key there): 2^bits ranges of hashes; the key has 40 bits."""
    return (g >> np.uint64(_HASH - bits)).astype(np.uint32), g >> np.uint64(max(0, _HASH - _KEY - bits)) & _LOW


def _whole_hash(part: np.ndarray | int, key: np.ndarray, bits: int) -> np.ndarray:
    """The n-gram again, but for the lowest bits that the key has no room for."""
    over = bits - (_HASH - _KEY)
    return (np.uint64(part) >> np.uint64(max(0, over)) << np.uint64(_KEY) | key) << np.uint64(max(0, -over))


class _Held:
    """Sets gathered until they are cut up together."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.mass = self.seen = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray, owner: np.ndarray, keys: np.ndarray) -> bool:
        self.parts.append((ids, sizes, (owner + self.seen).astype(np.uint32), keys))
        self.mass, self.seen = self.mass + len(keys), self.seen + len(ids)
        return self.mass >= CHUNK

    def take(self) -> list[np.ndarray]:
        out = [np.concatenate(x) for x in zip(*self.parts)]
        self.__init__()
        return out


def _segments(source: DataFrame, of, bits: int) -> DataFrame:  # noqa: ANN001
    """Each set cut into 2^bits segments. of: from a batch of source, (ids, sizes, owner, n-grams) of some of its documents at a time."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        cut = min(bits, LEVEL)

        def pieces() -> pa.RecordBatch:
            ids, sizes, owner, g = held.take()
            part, key = _fragment(g, cut)
            return _pieces(part, ids, sizes, owner, key, 5)

        for batch in batches:
            for sets in of(batch):
                if held.add(*sets):
                    yield pieces()
        if held.parts:
            yield pieces()
        release()

    return _finer(source.mapInArrow(first, PIECES), bits, 5)


def _finer(rows: DataFrame, bits: int, width: int) -> DataFrame:
    """Rows cut at LEVEL bits are shuffled and cut further, as often as it takes. Width 5: by n-grams; width 6: by documents."""
    done = min(bits, LEVEL)
    while done < bits:
        new = min(bits, done + LEVEL)

        def work(batches: Iterator[pa.RecordBatch], done: int = done, new: int = new) -> Iterator[pa.RecordBatch]:
            held = _Held()

            def pieces() -> pa.RecordBatch:
                ids, sizes, owner, keys = held.take()
                part, keys = _fragment(keys, new) if width == 5 else (bucket_of(ids, 1 << new)[owner].astype(np.uint32), keys)
                return _pieces(part, ids, sizes, owner, keys, width)

            for batch in batches:
                for i in range(len(batch)):
                    ids, sizes, owner, keys = _unpacked(batch.slice(i, 1), width)
                    if held.add(ids, sizes, owner, _whole_hash(batch.column(0)[i].as_py(), keys, done) if width == 5 else keys):
                        yield pieces()
            if held.parts:
                yield pieces()

        rows = rows.repartitionById(1 << done, F.col("part")).sortWithinPartitions("part").mapInArrow(work, PIECES)
        done = new
    return rows


def _shared(bits: int):  # noqa: ANN202
    """A fragment's n-grams that several documents have, as codes (frequency class, hash), sorted out by buckets of documents."""

    def work(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        release()
        ids, sizes, owner, keys = _unpacked(table, 5)
        order = np.argsort(keys)
        df = _runs(keys[order])[1]
        many = np.repeat(df > 1, df)
        level = np.repeat(np.minimum(_CLASSES, np.log2(df).astype(np.int64)).astype(np.uint64), df)[many]
        at = order[many]
        codes = level << np.uint64(_HASH) | _whole_hash(part, keys[at], bits)
        # together by document
        order = np.argsort(owner[at], kind="stable")
        who = owner[at][order]
        return pa.Table.from_batches([_pieces(bucket_of(ids, 1 << min(bits, LEVEL))[who].astype(np.uint32), ids, sizes, who, codes[order], 6)])

    return work


def _least(size: np.ndarray, threshold: float) -> np.ndarray:
    """The smallest overlap that a set of this size can have with a similar one."""
    return np.ceil(size * threshold - 1e-9).astype(np.int64)


def _alive(threshold: float):  # noqa: ANN202
    """The documents of a bucket that can have partners, their shared n-grams in the global order."""

    def work(table: pa.Table) -> pa.Table:
        release()
        docs, sizes, owner, codes = _unpacked(table, 6)
        ids, which = np.unique(docs, return_inverse=True)
        size = np.zeros(len(ids), np.int64)
        size[which] = sizes
        kept = np.bincount(which[owner], minlength=len(ids)).astype(np.int64)
        ok = kept >= _least(size, threshold)
        on = np.flatnonzero(ok[which[owner]])
        codes = codes[on][np.lexsort((codes[on], which[owner[on]]))]
        return pa.table({"doc_id": ids[ok], "size": size[ok], "kept": kept[ok], "grams": _binaries(codes, kept[ok])})

    return work


def _narrow(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _wide(raw: bytes, width: int) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8).reshape(-1, width)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, :width] = part
    return out.view("<u8").ravel()


def _binaries(codes: np.ndarray, counts: np.ndarray) -> pa.Array:
    raw, ends = _narrow(codes, 6), np.cumsum(counts) * 6
    return pa.array([raw[a:b] for a, b in zip((ends - counts * 6).tolist(), ends.tolist())], pa.binary())


def _sets(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    return [_wide(r, 6) for r in column.to_pylist()]


def _of_texts(n: int):  # noqa: ANN202
    def of(batch: pa.RecordBatch) -> Iterator[tuple]:
        ids = batch.column(0).to_numpy()
        for first, last, data, offsets in blocks(batch.column(1)):
            owner, g = grams(data, offsets, n)
            yield ids[first:last], np.bincount(owner, minlength=last - first), owner, g

    return of


def _alive_sets(rows: DataFrame, n: int, threshold: float) -> Table:
    """(doc_id, size, kept, grams) of the documents that share enough n-grams with others."""
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(30, max(0, math.ceil(math.log2(max(1, volume / 7 / MASS)))))
    shared = _segments(rows, _of_texts(n), bits).repartitionById(1 << bits, F.col("part")).groupBy("part").applyInArrow(_shared(bits), PIECES)
    alive = _finer(shared, bits, 6).repartitionById(1 << bits, F.col("part")).groupBy("part").applyInArrow(_alive(threshold), "doc_id long, size long, kept long, grams binary")
    return Table(alive, 1 << min(bits, BUCKETS), "doc_id")


# Postings on their way: one row holds those of many documents in one fragment, side is the part of a crowded n-gram's postings in the tile (row, col).
POSTINGS = "part int, row int, col int, side int, docs binary, cores binary, sizes binary, counts binary, keys binary, rests binary"


def _posted(threshold: float, pieces: int):  # noqa: ANN202
    """The prefixes of sets (doc_id, core, size, kept, grams)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, core, size, kept = (batch.column(i).to_numpy() for i in range(4))
            many = kept - _least(size, threshold) + 1
            code = np.concatenate([np.zeros(0, np.uint64), *(_wide(r[: 6 * k], 6) for r, k in zip(batch.column(4).to_pylist(), many.tolist()))])
            owner = np.repeat(np.arange(len(many)), many)
            rest = np.repeat(kept, many) - 1 - ragged(np.zeros(len(many), np.int64), many)
            # the frequency class tells which n-grams have many postings: these are cut into parts, and parts meet in pairs
            parts = -(-(np.int64(2) << (code >> np.uint64(_HASH)).astype(np.int64)) // CROWD)
            side = (mix(ids.astype(np.uint64))[owner] % parts.astype(np.uint64)).astype(np.int64)
            which, other = np.repeat(np.arange(len(code)), parts), ragged(np.zeros(len(code), np.int64), parts)
            side = side[which]
            row, col = np.minimum(side, other), np.maximum(side, other)
            part = (mix(code[which] ^ mix((row << 32 | col).astype(np.uint64))) % np.uint64(pieces)).astype(np.int64)
            order = np.lexsort((which, side, col, row, part))
            which, side, row, col, part = which[order], side[order], row[order], col[order], part[order]
            new = np.r_[True, np.any([np.diff(x) != 0 for x in (part, row, col, side)], 0)][: len(part)]
            start = np.flatnonzero(new)
            out: list[list] = [[] for _ in range(10)]
            for s, e in zip(start.tolist(), np.r_[start[1:], len(part)].tolist()):
                w = which[s:e]
                own, count = _runs(owner[w])
                who = owner[w][own]
                for column, v in zip(out, (int(part[s]), int(row[s]), int(col[s]), int(side[s]), _small(ids[who]), _small(core[who]), _small(size[who]), _small(count), _narrow(code[w], 6), rest[w].astype("<i4").tobytes())):
                    column.append(v)
            kinds = [pa.int32()] * 4 + [pa.binary()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=[f.split()[0] for f in POSTINGS.split(", ")])

    return work


def _list(rows: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    big = zstandard.ZstdDecompressor()
    return np.concatenate([np.zeros(0, np.int64), *(np.cumsum(np.frombuffer(big.decompress(v), "<i8")) for v in rows.column(name).to_pylist())])


def _candidates(threshold: float):  # noqa: ANN202
    """Pairs of documents of different cores that share an n-gram in both prefixes and whose sizes and positions allow enough overlap.

    Where the postings of an n-gram are cut up, row and col name the two parts that meet; a pair of parts gives only pairs from one to the other.
    """

    def work(table: pa.Table) -> pa.Table:
        doc, core, size, counts = (_list(table, c) for c in ("docs", "cores", "sizes", "counts"))
        gram, rest = _wide(b"".join(table.column("keys").to_pylist()), 6), np.frombuffer(b"".join(table.column("rests").to_pylist()), "<i4")
        each = [len(x) // 4 for x in table.column("rests").to_pylist()]
        row, col, side = (np.repeat(table.column(c).to_numpy(), each) for c in ("row", "col", "side"))
        ids, who = np.unique(doc, return_inverse=True)
        who, core, size = (np.repeat(x, counts) for x in (who, core, size))
        order = np.lexsort((who, core, col, row, gram))
        gram, who, core, side, row, col, size, rest = gram[order], who[order], core[order], side[order], row[order], col[order], size[order], rest[order].astype(np.int64)
        new = np.r_[True, (gram[1:] != gram[:-1]) | (row[1:] != row[:-1]) | (col[1:] != col[:-1])][: len(gram)]
        place = np.arange(len(gram))
        start = np.maximum.accumulate(np.where(new, place, 0))
        alone = np.maximum.accumulate(np.where(new | np.r_[True, core[1:] != core[:-1]][: len(gram)], place, 0))
        # each pairs with those before it that are of other cores
        many = alone - start
        ends = np.cumsum(many)
        found, done = [], 0
        while done < len(gram):
            upto = max(int(np.searchsorted(ends, (ends[done - 1] if done else 0) + 400_000, "right")), done + 1)
            left, right = np.repeat(np.arange(done, upto), many[done:upto]), ragged(start[done:upto], many[done:upto])
            small, large = np.minimum(size[left], size[right]), np.maximum(size[left], size[right])
            need = np.ceil((size[left] + size[right]) * threshold / (1 + threshold) - 1e-9)
            ok = (small >= large * threshold - 1e-9) & (1 + np.minimum(rest[left], rest[right]) >= need) & ((row[left] == col[left]) | (side[left] != side[right]))
            a, b = who[right[ok]], who[left[ok]]
            found.append(np.unique(np.minimum(a, b) * len(ids) + np.maximum(a, b)))
            done = upto
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
        return pa.table({"a": ids[pairs // max(1, len(ids))], "b": ids[pairs % max(1, len(ids))]})

    return work


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(_sets(batch.column(4)), _sets(batch.column(5)))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(both, pa.int64())], names=["a", "b", "sa", "sb", "overlap"])


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("size").alias(f"s{x}"), F.col("grams").alias(f"g{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb", "ga", "gb").mapInArrow(_common, "a long, b long, sa long, sb long, overlap long")
    return keep(both.where(F.col("overlap").cast("double") / (F.col("sa") + F.col("sb") - F.col("overlap")).cast("double") >= threshold).select("a", "b"))


def _sketched(threshold: float):  # noqa: ANN202
    """Pairs of min-hashes of the prefixes of sets (doc_id, size, kept, grams): what is common to unlike documents comes last in the order, and seldom agrees twice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = batch.column(2).to_numpy() - _least(batch.column(1).to_numpy(), threshold) + 1
            rare = np.concatenate([np.zeros(0, np.uint64), *(_wide(r[: 6 * k], 6) for r, k in zip(batch.column(3).to_pylist(), many.tolist()))])
            start = np.cumsum(many) - many
            least = [np.minimum.reduceat(mix(rare + np.uint64(k << 50)), start) if len(rare) else rare for k in range(2 * SKETCH)]
            keys = np.stack([mix(x ^ mix(y)) for x, y in zip(least[::2], least[1::2])], 1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(keys.ravel(), np.arange(len(keys) + 1) * SKETCH, pa.int64())], names=["doc_id", "keys"])

    return work


def links_within(ids: np.ndarray, size: np.ndarray, part: np.ndarray, sets: list[np.ndarray], threshold: float, row: int, col: int, side: int = 1024, span: int = 4096) -> np.ndarray:
    """Of each document the number of others that are similar to it: among all where row equals col, else from part row to part col."""
    order = np.lexsort((ids, size))
    size, part = size[order], part[order]
    sets = [sets[i] for i in order.tolist()]
    count = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    at = np.r_[0, np.cumsum(count)]
    owner = np.repeat(np.arange(len(sets)), count)
    links = np.zeros(len(sets), np.int64)
    for i in range(0, len(sets), side):
        for j in range(i, len(sets), side):
            if size[j] * threshold > size[min(i + side, len(sets)) - 1] + 1e-9:
                break  # those behind are longer still
            ends = (min(i + side, len(sets)), min(j + side, len(sets)))
            x, y = flat[at[i] : at[ends[0]]], flat[at[j] : at[ends[1]]]
            wanted = np.unique(x) if i == j else np.intersect1d(x, y)
            overlap = np.zeros((ends[0] - i, ends[1] - j), np.float32)
            # fragment by fragment of the global order; sums of ones below 2^24 are exact
            for c in range(0, len(wanted), span):
                fragment = wanted[c : c + span]
                ones = []
                for values, base, end in ((x, i, ends[0]),) if i == j else ((x, i, ends[0]), (y, j, ends[1])):
                    k = np.searchsorted(fragment, values)
                    hit = np.flatnonzero(fragment[np.minimum(k, len(fragment) - 1)] == values)
                    m = np.zeros((end - base, len(fragment)), np.float32)
                    m[owner[at[base] : at[end]][hit] - base, k[hit]] = 1
                    ones.append(m)
                overlap += ones[0] @ ones[-1].T
            total = size[i : ends[0], None] + size[j : ends[1]] - overlap.astype(np.float64)
            similar = overlap / total >= threshold
            if row != col:
                similar &= part[i : ends[0], None] != part[j : ends[1]]
            if i == j:
                np.fill_diagonal(similar, False)
                links[i : ends[0]] += similar.sum(1)
            else:
                links[i : ends[0]] += similar.sum(1)
                links[j : ends[1]] += similar.sum(0)
    out = np.empty(len(sets), np.int64)
    out[order] = links
    return out


def _core_links(threshold: float):  # noqa: ANN202
    def work(table: pa.Table) -> pa.Table:
        ids, core, size, part, row, col = (table.column(c).to_numpy() for c in ("doc_id", "core", "size", "part", "row", "col"))
        sets, order = _sets(table.column("grams")), np.argsort(core, kind="stable")
        links = np.zeros(len(ids), np.int64)
        for s, k in zip(*(x.tolist() for x in _runs(core[order]))):
            these = order[s : s + k]
            links[these] = links_within(ids[these], size[these], part[these], [sets[i] for i in these.tolist()], threshold, int(row[these[0]]), int(col[these[0]]))
        return pa.table({"doc_id": ids, "links": links})

    return work


def join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """(doc_id, class_id, links): one row for each document.

    links is the number of other sets of n-grams that are similar to the document's own (documents
    with the same set have the same links, and are none to each other); a class is what such links and equal sets connect,
    class_id the least doc_id in it.
    """
    rows = docs.select(whole("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    everyone = rows.select("doc_id").distinct()
    rows = rows.where("text is not null")
    repeated = keep(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not repeated.isEmpty():
        once = rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        rows = rows.join(repeated, "doc_id", "left_anti").unionAll(once)
    table = _alive_sets(rows, n, threshold)
    alive = table.df

    # documents with the same set; a set that lost n-grams had some that no other has
    signs = alive.where("kept = size").select("doc_id", "size", F.md5("grams").alias("sign"))
    least = signs.groupBy("size", "sign").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = keep(signs.join(least, ["size", "sign"]).where("doc_id <> rep").select("doc_id", "rep"))
    sets = alive.join(copies.select("doc_id"), "doc_id", "left_anti")
    total = sets.agg(F.sum("kept")).first()[0] or 0

    near = leaders(sets.select("doc_id", "size", "kept", "grams").mapInArrow(_sketched(threshold), "doc_id long, keys array<long>"))
    core = cores(_similar(near, sets, threshold))

    within = placed(sets.select("doc_id", "size", "kept", "grams"), core, "kept", PART).drop("kept")
    within = within.groupBy("grp").applyInArrow(_core_links(threshold), "doc_id long, links long")
    within = keep(within.groupBy("doc_id").agg(F.sum("links").alias("links")))

    # pairs between cores
    posted = sets.join(core, "doc_id", "left").select("doc_id", F.coalesce("core", "doc_id").alias("core"), "size", "kept", "grams")
    posted = posted.mapInArrow(_posted(threshold, max(1, math.ceil(total * (1 - threshold) / POSTED))), POSTINGS)
    pairs = keep(posted.groupBy("part").applyInArrow(_candidates(threshold), "a long, b long").distinct())
    across = _similar(pairs, sets, threshold)

    out = classified(everyone, sets, copies, core, within, across)
    table.drop()
    return out


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """The documents without near copies: of each class the least doc_id stays, all columns with it.

    Rows of a null doc_id (or one that is no whole number) stay; of rows that repeat doc_id and text one stays; rows that repeat a
    doc_id with other texts stay or go with it. The join on ids is Spark's to plan, at every size.
    """
    gone = f"gone{'_' * max(map(len, docs.columns))}"  # no column's name
    classes = join(docs, threshold, n).where("doc_id <> class_id").select(F.col("doc_id").alias(gone))
    key = "row" + gone
    ids = docs.where(whole("doc_id").isNotNull()).select(whole("doc_id").alias(gone)).groupBy(gone).count().where("count > 1").select(gone)
    twice = keep(ids)
    if not twice.isEmpty():
        same = docs.join(twice, whole("doc_id") == F.col(gone), "left_semi")
        rest = docs.join(twice, whole("doc_id") == F.col(gone), "left_anti")
        first = F.row_number().over(Window.partitionBy(whole("doc_id"), F.col("text")).orderBy(F.lit(0)))
        docs = rest.unionAll(same.withColumn(key, first).where(F.col(key) == 1).drop(key))
    return docs.join(classes, whole("doc_id") == F.col(gone), "left_anti")


def oracle(threshold: float = THRESHOLD, n: int = N) -> str:
    """The same rows in SQL by comparing all pairs that share an n-gram."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, '{upper}', '{lower}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {n - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {n - 1}], ' ')))) AS g FROM w WHERE len(w) > 0),
r AS (SELECT doc_id, g, len(g) AS size, min(doc_id) OVER (PARTITION BY md5(array_to_string(g, '|'))) AS rep FROM s),
e AS (SELECT doc_id, size, unnest(g) AS gram FROM r WHERE doc_id = rep),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.size) AS sa, any_value(b.size) AS sb, count(*) AS c FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
p AS (SELECT a, b FROM o WHERE c::DOUBLE / (sa + sb - c)::DOUBLE >= {threshold}),
d AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c AS (SELECT DISTINCT a AS doc_id, a AS top FROM d UNION SELECT d.b, c.top FROM c JOIN d ON c.doc_id = d.a WHERE c.top < d.b),
k AS (SELECT doc_id, min(top) AS top FROM c GROUP BY 1),
m AS (SELECT a AS doc_id, count(*) AS links FROM d GROUP BY 1)
SELECT documents.doc_id, coalesce(k.top, r.rep, documents.doc_id) AS class_id, coalesce(m.links, 0)::BIGINT AS links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) documents LEFT JOIN r ON r.doc_id = documents.doc_id LEFT JOIN k ON k.doc_id = r.rep LEFT JOIN m ON m.doc_id = r.rep"""
