"""Token ids as compact binary: frequency ranks in a byte-aligned variable-length code.

Texts are tokenised once with a published vocabulary. Tokens are counted over all
documents and ranked, the most frequent first, so that common tokens get small ids.
A document's ranks are stored as one to four data bytes each, the lengths apart in
two-bit codes, four to a control byte. Decoding looks up the control bytes in a table of
lengths and gathers the data with numpy.

Defined cases: a null or empty text has no tokens and empty buffers; tokens of equal
count rank by token id; repeated rows count and are encoded each; an id that is no whole number counts as null and its row is
encoded all the same; very long texts are encoded whole; other columns are
ignored, whatever their names; a table without tokens has no row of ranks, so an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, lists, ragged, whole
from .pretoken import encoded

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_NO_SPLIT = r"(?s:.+)"

#: Data bytes of the four values of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def load(path: str = VOCABULARY) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def encoder(ranks: dict[bytes, int]) -> Callable:
    """From (bytes, offsets) of pieces to (token ids, offsets)."""
    import tiktoken

    single = tiktoken.Encoding("own", pat_str=_NO_SPLIT, mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def encode(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, at = text.tobytes(), offsets.tolist()
        found = [single(raw[a:b]) for a, b in zip(at[:-1], at[1:])]
        flat = np.fromiter((x for f in found for x in f), np.int32)
        return flat, np.r_[0, np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))]

    return encode


def put(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(control bytes, their offsets, data bytes, their offsets) of runs of values below 2^32."""
    values = values.astype("<u4")
    code = (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    count = np.diff(offsets)
    quads = -(-count // 4)
    control_at = np.r_[0, np.cumsum(quads)]
    wide = np.zeros(int(control_at[-1]) * 4, np.uint8)
    wide[np.arange(len(values)) + np.repeat(control_at[:-1] * 4 - offsets[:-1], count)] = code
    wide = wide.reshape(-1, 4)
    control = wide[:, 0] | wide[:, 1] << 2 | wide[:, 2] << 4 | wide[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control, control_at, data, np.r_[0, np.cumsum(code.astype(np.int64) + 1)][offsets]


def get(control: np.ndarray, control_at: np.ndarray, data: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The values of runs whose control and data bytes follow each other, count of each run."""
    length = LENGTHS[control].ravel()[ragged(control_at[:-1] * 4, count)]
    place = (np.cumsum(length) - length)[:, None] + np.arange(4)
    used = np.arange(4) < length[:, None]
    out = np.zeros((len(length), 4), np.uint8)
    out[used] = data[place[used]]
    return out.view("<u4").ravel()


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def tokenised(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows of two sorts: (doc_id, n_tokens, packed ids) of documents, and (tokens, counts) of parts of the corpus."""
    held = docs.sparkSession.sparkContext.broadcast(load(vocabulary))  # a vocabulary, whatever the input
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("packed", pa.binary()), ("tokens", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(max(held.value.values()) + 1, np.int64)
        small = zstandard.ZstdCompressor(level=1)
        kind = np.uint16 if len(total) <= 1 << 16 else np.uint32

        for doc_ids, _, _, ids, at in encoded(batches, encoder(held.value)):
            total += np.bincount(ids, minlength=len(total))
            raw, n = ids.astype(kind).tobytes(), (at * kind().itemsize).tolist()
            packed = pa.array([small.compress(raw[a:b]) for a, b in zip(n[:-1], n[1:])], pa.binary())
            none = len(doc_ids)
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(at).astype(np.int32)), packed, pa.nulls(none, schema.field(3).type), pa.nulls(none, schema.field(4).type)], schema=schema)
        seen = np.flatnonzero(total)
        if len(seen):
            one = np.array([0, len(seen)])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), lists(seen, one, pa.int32()), lists(total[seen], one, pa.int64())], schema=schema)

    return docs.select(whole("doc_id").alias("doc_id"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, n_tokens int, packed binary, tokens array<int>, counts array<long>")


def ranks(parts: DataFrame) -> np.ndarray:
    """Token ids by falling count over the corpus (the inverse of the ids written). One row per vocabulary entry reaches the driver."""
    counted = parts.where("tokens is not null").select(F.explode(F.arrays_zip("tokens", "counts")).alias("x")).groupBy("x.tokens").agg(F.sum("x.counts").alias("n"))
    rows = counted.toPandas().sort_values(["n", "tokens"], ascending=[False, True])
    return rows["tokens"].to_numpy(np.int64)


SCHEMA = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("control", pa.binary()), ("data", pa.binary()), ("round_trip", pa.bool_())])
COLUMNS = "kind string, doc_id long, n_tokens int, control binary, data binary, round_trip boolean"


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(kind, doc_id, n_tokens, control, data, round_trip): a row of kind document for each row, and one of kind ranks with the token id of each rank, coded alike.

    round_trip tells whether the bytes, decoded by table lookup, gave the token ids again.
    """
    parts = keep(tokenised(docs, vocabulary))
    token_of = ranks(parts)
    rank_of = np.zeros(int(token_of.max(initial=0)) + 1, np.uint32)
    rank_of[token_of] = np.arange(len(token_of))
    held = docs.sparkSession.sparkContext.broadcast(rank_of)  # a vocabulary
    kind = np.uint16 if len(load(vocabulary)) <= 1 << 16 else np.uint32

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                raw = b"".join(big.decompress(p) for p in part.column(2).to_pylist())
                count = part.column(1).to_numpy().astype(np.int64)
                at, ids = np.r_[0, np.cumsum(count)], np.frombuffer(raw, kind)
                control, control_at, data, data_at = put(held.value[ids], at)
                wrong = np.r_[0, np.cumsum(token_of[get(control, control_at, data, count)] != ids)][at]
                yield pa.RecordBatch.from_arrays([pa.array(["document"] * len(part)), part.column(0), part.column(1), _binary(control, control_at), _binary(data, data_at), pa.array(wrong[1:] == wrong[:-1])], schema=SCHEMA)

    out = parts.where("tokens is null").select("doc_id", "n_tokens", "packed").mapInArrow(work, COLUMNS)
    control, _, data, _ = put(token_of, np.array([0, len(token_of)]))
    table = pa.table([["ranks"], pa.array([None], pa.int64()), pa.array([len(token_of)], pa.int32()), [control.tobytes()], [data.tobytes()], [True]], schema=SCHEMA)
    return out.unionAll(docs.sparkSession.createDataFrame(table)) if len(token_of) else out


def decode(stored: DataFrame) -> DataFrame:
    """(doc_id, ids): the vocabulary's token ids again. The one row of ranks reaches the driver."""
    table = stored.where("kind = 'ranks'").select("n_tokens", "control", "data").first()
    token_of = np.zeros(0, np.int64) if table is None else get(np.frombuffer(table[1], np.uint8), np.array([0, len(table[1])]), np.frombuffer(table[2], np.uint8), np.array([table[0]])).astype(np.int64)
    held = stored.sparkSession.sparkContext.broadcast(token_of)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                control, data = part.column(2).to_pylist(), part.column(3).to_pylist()
                count = part.column(1).to_numpy().astype(np.int64)
                found = get(np.frombuffer(b"".join(control), np.uint8), np.r_[0, np.cumsum([len(c) for c in control])].astype(np.int64), np.frombuffer(b"".join(data), np.uint8), count)
                yield pa.RecordBatch.from_arrays([part.column(0), lists(held.value[found], np.r_[0, np.cumsum(count)], pa.int32())], schema=schema)

    return stored.where("kind = 'document'").select("doc_id", "n_tokens", "control", "data").mapInArrow(work, "doc_id long, ids array<int>")
