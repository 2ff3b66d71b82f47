"""Packing of documents into training sequences by first-fit decreasing.

Documents are tokenised and go to randomised groups of a bounded expected size (a hash of the id,
so no order of the input leaks into a group). In each group pieces are placed
longest first into the first bin that has room; a tournament tree over the bin
capacities finds that bin in O(log bins). The bins are the result: sequences of token ids,
with a list of what is in them. Token ids are shuffled once, two bytes each.

Defined cases: a document's length is its number of tokens
plus one end token, so an empty or null text takes one token; a document longer
than a bin is cut into pieces of a full bin and a rest, none of it is dropped;
ties in length go by doc_id (nulls first), then by tokens, then by piece. An id that is no whole number counts as null. Rows that repeat an id (or
have none) are packed each on its own; beyond the first in a partition they are spread over the groups by their place in it, so that no
group grows with the number of copies. Very long texts are packed whole. An empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Bpe
from .common import lists, mix, ragged, release, whole
from .pretoken import encoded
from .token_ids import VOCABULARY, encoder, load

SCHEMA = "bin_id string, n_tokens int, doc_ids array<long>, doc_nos array<int>, first_tokens array<int>, lengths array<int>, tokens array<int>"


def first_fit(lengths: list[int], capacity: int) -> list[int]:
    """Bin of each length, taken in the order given; lengths are at most the capacity."""
    size = 1 << max(0, math.ceil(math.log2(max(1, len(lengths)))))
    tree = [capacity] * (2 * size)  # tree[i] is the largest room below node i; the leaves are bins
    out = []
    for n in lengths:
        i = 1
        while i < size:
            i *= 2
            if tree[i] < n:
                i += 1
        out.append(i - size)
        tree[i] -= n
        while i > 1:
            i //= 2
            a, b = tree[2 * i], tree[2 * i + 1]
            best = a if a > b else b
            if tree[i] == best:
                break
            tree[i] = best
    return out


def _grouped(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """(struct of doc_id and group, text) of batches (doc_id, hash of it, text)."""
    seen: set[int | None] = set()
    task = TaskContext.get()
    salt, row = np.uint64((task.partitionId() if task else 0) + 1) << np.uint64(40), 0
    for batch in batches:
        h = batch.column(1).to_numpy().view(np.uint64).copy()
        again = np.zeros(len(h), bool)
        for i, key in enumerate(batch.column(0).to_pylist()):
            again[i] = key in seen
            seen.add(key)
        place = np.arange(row, row + len(h)).astype(np.uint64)
        h[again] ^= mix(salt + place[again])
        row += len(h)
        yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([batch.column(0), pa.array((h % np.uint64(groups)).astype(np.int32))], ["doc_id", "grp"]), batch.column(2)], names=["key", "text"])


def pack(docs: DataFrame, capacity: int = 2048, group_docs: int = 8192, seed: int = 17, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each sequence: bin_id, n_tokens, and for each piece in it, in order, the doc_id, the
    number of the document in its group (a part of the bin_id), its first token in the document and its length; the token ids."""
    groups = max(1, math.ceil(docs.count() / group_docs))
    held = docs.sparkSession.sparkContext.broadcast(load(vocabulary))  # a vocabulary, whatever the input
    kind = np.uint16 if len(load(vocabulary)) < 1 << 16 else np.uint32

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = max(held.value.values()) + 1
        for key, _, _, ids, at in encoded(_grouped(batches, groups), encoder(held.value)):
            ends = at + np.arange(len(at))  # with an end token to each
            wide = np.full(ends[-1], end, kind)
            wide[np.arange(len(ids)) + np.repeat(np.arange(len(at) - 1), np.diff(at))] = ids
            raw, n = wide.tobytes(), (ends * kind().itemsize).tolist()
            yield pa.RecordBatch.from_arrays([key.field("grp"), key.field("doc_id"), pa.array([raw[a:b] for a, b in zip(n[:-1], n[1:])], pa.binary())], names=["grp", "doc_id", "packed"])

    def fill(table: pa.Table) -> pa.Table:
        release()
        grp = table.column("grp")[0].as_py()
        ids, packed = table.column("doc_id").to_pylist(), table.column("packed").to_pylist()
        rows = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, packed[i]))
        ids = pa.array([ids[i] for i in rows], pa.int64())
        flat, n = np.frombuffer(b"".join(packed[i] for i in rows), kind), np.array([len(packed[i]) // kind().itemsize for i in rows], np.int64)
        begin, pieces = np.cumsum(n) - n, -(-n // capacity)
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = piece * capacity
        length = np.minimum(n[row] - first, capacity)
        order = np.lexsort((piece, row, -length))
        row, first, length = row[order], first[order], length[order]
        bins = np.array(first_fit(length.tolist(), capacity), np.int64)
        by_bin = np.argsort(bins, kind="stable")
        bins, row, first, length = bins[by_bin], row[by_bin], first[by_bin], length[by_bin]
        new = np.flatnonzero(np.r_[True, np.diff(bins) > 0])
        cut, ends = np.r_[new, len(bins)], np.r_[0, np.cumsum(length)]
        tokens = flat[ragged(begin[row] + first, length)].astype(np.int32)
        doc_ids = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), ids.take(pa.array(row)))
        return pa.table({
            "bin_id": [f"{grp}-{b}" for b in bins[new].tolist()], "n_tokens": np.diff(ends[cut]).astype(np.int32), "doc_ids": doc_ids, "doc_nos": lists(row, cut, pa.int32()),
            "first_tokens": lists(first, cut, pa.int32()), "lengths": lists(length, cut, pa.int32()), "tokens": lists(tokens, ends[cut], pa.int32()),
        })

    rows = docs.select(whole("doc_id").alias("doc_id"), F.xxhash64(whole("doc_id"), F.lit(seed)).alias("h"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tokenise, "grp int, doc_id long, packed binary").groupBy("grp").applyInArrow(fill, SCHEMA)


def unpack(sequences: DataFrame, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.json") -> DataFrame:
    """(doc_id, text): the documents again, one row for each that was packed; a null text comes back empty."""
    held = sequences.sparkSession.sparkContext.broadcast(Bpe(vocabulary))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(1)
            n = np.diff(docs.offsets.to_numpy())
            flat = [batch.column(i).flatten() for i in range(1, 5)]
            tokens, lengths = batch.column(5).flatten().to_numpy().astype("<i4").tobytes(), flat[3].to_numpy().astype(np.int64)
            ends = (np.cumsum(lengths) * 4).tolist()
            grp = batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([grp, *flat[:3], pa.array([tokens[b - k * 4 : b] for b, k in zip(ends, lengths.tolist())], pa.binary())], names=["grp", "doc_id", "doc_no", "first_token", "ids"])

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held.value
        for batch in batches:
            ids = [np.frombuffer(b"".join(x["ids"] for x in parts), "<i4")[:-1] for parts in batch.column(1).to_pylist()]
            raw, at = bpe.decode(np.concatenate([np.zeros(0, np.int32), *ids]), np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int64))
            raw = raw.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.string())], names=["doc_id", "text"])

    pieces = sequences.select(F.substring_index("bin_id", "-", 1).alias("grp"), "doc_ids", "doc_nos", "first_tokens", "lengths", "tokens").mapInArrow(cut, "grp string, doc_id long, doc_no int, first_token int, ids binary")
    whole_docs = pieces.groupBy("grp", "doc_no").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("first_token", "ids"))).alias("parts"))
    return whole_docs.select("doc_id", "parts").mapInArrow(text, "doc_id long, text string")
