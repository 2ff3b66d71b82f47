"""BPE encoding and decoding with a pair occurrence index.

The vocabulary and its merges are those of a published byte-level tokenizer; none
is trained. In each stretch of a partition the distinct pieces stand one after the
other in one array of symbols. An index maps each pair to all its positions.
The active ranks are applied in ascending order: a merge is carried out at all
positions of its pair at once, and the lists of the pairs to its left and right are
updated. Decoding looks the ids' bytes up in a table.

Defined cases: a null or empty text has no ids and decodes to an empty text; strings
of special tokens are ordinary text; repeated rows are encoded each; an id that is no whole number counts as null and its row is
encoded all the same; a very long text is encoded whole; of touching pairs of the same rank the left one is merged first; other columns
are ignored, whatever their names; unknown or null ids decode to nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lists, ragged, whole
from .pretoken import encoded

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def _byte_names() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A vocabulary as arrays: byte -> id, (left, right) -> (rank, id), id -> bytes."""

    def __init__(self, path: str = VOCABULARY):
        model = json.loads(Path(path).read_text())["model"]
        vocab, names = model["vocab"], _byte_names()
        self.size = max(vocab.values()) + 1
        pieces = [b""] * self.size
        for token, i in vocab.items():
            if all(ch in names for ch in token):
                pieces[i] = bytes(names[ch] for ch in token)
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.starts = np.r_[0, np.cumsum([len(p) for p in pieces])]
        self.of_byte = np.zeros(256, np.int32)
        for ch, b in names.items():
            self.of_byte[b] = vocab[ch]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int32)
        self.right = np.array([vocab[b] for _, b in merges], np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = self.left.astype(np.int64) * self.size + self.right
        self.by_key = np.argsort(keys)
        self.keys = keys[self.by_key]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it is not merged."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], -1)

    def encode(self, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces text[offsets[i]:offsets[i + 1]] and their offsets."""
        n = len(text)
        sym = np.r_[self.of_byte[text], np.int32(-1)]  # -1: no symbol (any more)
        nxt = np.arange(1, n + 2, dtype=np.int32)
        prv = np.arange(-1, n, dtype=np.int32)
        filled = offsets[:-1] < offsets[1:]
        nxt[offsets[1:][filled] - 1] = n  # position n stands for none
        prv[offsets[:-1][filled]] = n
        if not n:
            return sym[:0], offsets
        at = np.flatnonzero(nxt[:n] < n)
        ranks = self.rank(sym[at], sym[at + 1])
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        active, first = np.unique(ranks[order], return_index=True)
        index: dict[int, list[np.ndarray]] = dict(zip(active.tolist(), ([p] for p in np.split(at[order], first[1:]))))
        queue = active.tolist()  # sorted, so a heap
        while queue:
            rank = heapq.heappop(queue)
            parts = index.pop(rank, None)
            if parts is None:
                continue
            a, b, c = self.left[rank], self.right[rank], self.made[rank]
            pos = np.unique(np.concatenate(parts))
            pos = pos[(sym[pos] == a) & (sym[nxt[pos]] == b)]
            if a == b and len(pos) > 1:  # of touching pairs take every other one, from the left
                head = np.r_[True, nxt[pos[:-1]] != pos[1:]]
                k = np.arange(len(pos))
                pos = pos[(k - np.maximum.accumulate(np.where(head, k, 0))) % 2 == 0]
            if not len(pos):
                continue
            gone = nxt[pos]
            after = nxt[gone]
            sym[pos], sym[gone], nxt[pos] = c, -1, after
            prv[after] = pos
            before = prv[pos]
            where = np.concatenate([before[before < n], pos[after < n]])
            if not len(where):
                continue
            ranks = self.rank(sym[where], sym[nxt[where]])
            ok = ranks >= 0
            if not ok.any():
                continue
            where, ranks = where[ok], ranks[ok]
            order = np.argsort(ranks, kind="stable")
            where, ranks = where[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for r, part in zip(ranks[np.r_[0, cuts]].tolist(), np.split(where, cuts)) if len(cuts) else ((int(ranks[0]), where),):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(queue, r)
        alive = sym[:n] >= 0
        return sym[:n][alive], np.r_[0, np.cumsum(alive)][offsets]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of runs of ids and their offsets."""
        ids = np.where((ids >= 0) & (ids < self.size), ids, 0)
        size = self.starts[ids + 1] - self.starts[ids]
        return self.bytes[ragged(self.starts[ids], size)], np.r_[0, np.cumsum(size)][offsets]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): round_trip tells whether the ids decode to the text again."""
    held = docs.sparkSession.sparkContext.broadcast(Bpe(vocabulary))  # a vocabulary, whatever the input
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held.value
        for doc_ids, data, offsets, ids, at in encoded(batches, bpe.encode):
            back, back_at = bpe.decode(ids, at)
            if np.array_equal(back_at, offsets):
                wrong = np.r_[0, np.cumsum(back != data)][offsets]
                same = wrong[1:] == wrong[:-1]
            else:
                same = np.array([np.array_equal(back[a:b], data[c:d]) for a, b, c, d in zip(back_at[:-1], back_at[1:], offsets[:-1], offsets[1:])])
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(at).astype(np.int32)), lists(ids, at, pa.int32()), pa.array(same)], schema=schema)

    return docs.select(whole("doc_id").alias("doc_id"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, n_tokens int, ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    held = tokens.sparkSession.sparkContext.broadcast(Bpe(vocabulary))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held.value
        for batch in batches:
            flat = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            at = flat.offsets.to_numpy()
            ids = flat.values.fill_null(-1).to_numpy()[at[0] : at[-1]] if len(flat) else np.zeros(0, np.int32)
            known = (ids >= 0) & (ids < bpe.size)
            back, ends = bpe.decode(ids[known], np.r_[0, np.cumsum(known)][at - at[0]])
            raw = back.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.string())], schema=schema)

    return tokens.select(whole("doc_id").alias("doc_id"), "ids").mapInArrow(work, "doc_id long, text string")
