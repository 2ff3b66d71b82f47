"""Visual words: local descriptors, codebooks, histograms, visual TF-IDF, and ranking by cosine.

Pixels come from portable greymaps and pixmaps; other formats need an image library, which may be plugged in through ``describe``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors of a side of the blocks in which all pairs are compared, at most; a block is compared with a strip of the other at a time.
SIDE, STRIP = 16384, 1024
#: Blocks of a table that would fit into fewer, so that all cores have work.
_LEAST_BLOCKS = 8


def pixels(raw: bytes) -> np.ndarray:
    """Brightness from 0 to 1 of a binary greymap (P5) or pixmap (P6), a row for each line."""
    head = re.match(rb"(P[56])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s", raw)
    if not head:
        raise ValueError("neither a binary greymap nor a pixmap")
    width, height, most = (int(head[i]) for i in (2, 3, 4))
    colours = 3 if head[1] == b"P6" else 1
    data = np.frombuffer(raw, np.uint8 if most < 256 else ">u2", width * height * colours, head.end()).reshape(height, width, colours) / most
    return data @ np.array([0.299, 0.587, 0.114]) if colours == 3 else data[..., 0]


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image at another size, between its pixels by their distances."""
    if not image.size:
        raise ValueError("an image without pixels")
    place = [np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in zip((height, width), image.shape)]
    low = [p.astype(np.int64) for p in place]
    high = [np.minimum(a + 1, m - 1) for a, m in zip(low, image.shape)]
    part = [p - a for p, a in zip(place, low)]
    lines = image[low[0]] * (1 - part[0])[:, None] + image[high[0]] * part[0][:, None]
    return lines[:, low[1]] * (1 - part[1]) + lines[:, high[1]] * part[1]


def gradients(image: np.ndarray, patch: int = 16, side: int = 256) -> np.ndarray:
    """One descriptor of 128 values for each patch that is not flat: of its 4 x 4 cells the strength of brightness changes in 8 directions, of length one.

    A larger image is brought to ``side`` pixels first.
    """
    if max(image.shape) > side:
        image = resize(image, *(max(1, round(n * side / max(image.shape))) for n in image.shape[::-1]))
    if min(image.shape) < patch:
        return np.zeros((0, 128))
    dy, dx = np.gradient(image)
    strength, turn = np.hypot(dx, dy), (np.floor((np.arctan2(dy, dx) + np.pi) / (2 * np.pi) * 8).astype(np.int64)) % 8
    down, across = (n // patch for n in image.shape)
    y, x = np.mgrid[: down * patch, : across * patch]
    cell = y % patch * 4 // patch * 4 + x % patch * 4 // patch
    place = ((y // patch * across + x // patch) * 16 + cell) * 8 + turn[: down * patch, : across * patch]
    out = np.bincount(place.ravel(), strength[: down * patch, : across * patch].ravel(), down * across * 128).reshape(-1, 128)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.maximum(length, 1e-12))[length[:, 0] > 1e-9]


def describe_pixels(raw: bytes) -> np.ndarray:
    """The descriptors of an image file."""
    return gradients(pixels(raw))


def describe(images: DataFrame, extract: Callable[[bytes], np.ndarray] = describe_pixels, key: str = "path", content: str = "content") -> DataFrame:
    """(key, descriptors) by a function from the bytes of a file to a matrix of descriptors; files it can't read are left out."""
    kind = images.schema[key].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, raw in zip(frame[key], frame[content]):
                try:
                    out.append((k, [row.tolist() for row in np.asarray(extract(raw), float)]))
                except (ValueError, OSError):
                    continue
            yield pd.DataFrame(out, columns=[key, "descriptors"])

    return images.select(key, content).mapInPandas(work, f"`{key}` {kind}, descriptors array<array<double>>")


def cut_descriptors(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(key, descriptors): one long vector cut into descriptors of size values."""
    n = (F.size(vector) / size).cast("int")
    return rows.select(key, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(F.col(vector), i * size + 1, F.lit(size)).cast("array<double>")).alias("descriptors"))


def vocabulary(descriptors: DataFrame, words: int = 1000, seed: int = 42) -> list[list[float]]:
    """Centres of k-means over all descriptors. The codebook has a fixed size."""
    points = descriptors.select(F.explode("descriptors").alias("d")).select(array_to_vector("d").alias("features"))
    return [c.tolist() for c in KMeans(k=words, seed=seed, initSteps=3).fit(points).clusterCenters()]


def reduce_dimensions(rows: DataFrame, vector: str, k: int) -> DataFrame:
    """The rows with vector replaced by its first k principal components."""
    data = rows.withColumn("_in", array_to_vector(F.col(vector).cast("array<double>")))
    return PCA(k=k, inputCol="_in", outputCol="_out").fit(data).transform(data).withColumn(vector, vector_to_array("_out")).drop("_in", "_out")


def words_of(x: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each row by squared distance, the lowest in a tie."""
    away = (x**2).sum(1)[:, None] + (codebook**2).sum(1) - 2 * (x @ codebook.T)
    out = away.argmin(1)
    # where rounding may have decided, by the differences themselves
    close = away <= away.min(1, keepdims=True) + 1e-9 * (1 + np.abs(away).max(1, keepdims=True))
    for i in np.flatnonzero(close.sum(1) > 1):
        centres = np.flatnonzero(close[i])
        out[i] = centres[((codebook[centres] - x[i]) ** 2).sum(1).argmin()]
    return out


def histogram(descriptors: DataFrame, codebook: list[list[float]], key: str) -> DataFrame:
    """(key, word, n) of the words that occur; descriptors has one row or more for each key. An image without descriptors has no row."""
    kind = descriptors.schema[key].dataType.simpleString()
    held = descriptors.sparkSession.sparkContext.broadcast(np.asarray(codebook, float))  # a codebook has a fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = held.value
        for batch in batches:
            some = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            count = np.diff(some.offsets.to_numpy())
            flat = some.flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, book.shape[1])
            word = np.concatenate([np.zeros(0, np.int64), *(words_of(flat[i : i + 4096], book) for i in range(0, len(flat), 4096))])
            both, n = np.unique(np.repeat(np.arange(len(count)), count) * len(book) + word, return_counts=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(both // len(book))), pa.array((both % len(book)).astype(np.int32)), pa.array(n.astype(np.int64))], names=[key, "word", "n"])

    each = descriptors.select(key, F.col("descriptors").cast("array<array<double>>")).mapInArrow(work, f"`{key}` {kind}, word int, n long")
    return each.groupBy(key, "word").agg(F.sum("n").alias("n"))


def tf_idf(hist: DataFrame, key: str) -> DataFrame:
    """(key, word, w): n * (ln((N + 1) / (df + 1)) + 1), divided by the row's length + 1e-10."""
    total = hist.agg(F.countDistinct(key).alias("images"))
    df = hist.where("n > 0").groupBy("word").agg(F.countDistinct(key).alias("df"))
    raw = hist.join(df, "word").crossJoin(F.broadcast(total)).select(key, "word", (F.col("n") * (F.log((F.col("images") + 1) / (F.col("df") + 1)) + 1)).alias("raw"))
    size = raw.groupBy(key).agg((F.sqrt(F.sum(F.col("raw") * F.col("raw"))) + 1e-10).alias("size"))
    return raw.join(size, key).select(key, "word", (F.col("raw") / F.col("size")).alias("w"))


def nearest(weighted: DataFrame, key: str, query: object, k: int) -> DataFrame:
    """(key, score): the k images of highest cosine with the queried one, itself left out before the cut; ties by key."""
    size = lambda w: w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    asked = weighted.where(F.col(key) == F.lit(query)).select("word", F.col("w").alias("q"))
    dots = weighted.where(F.col(key) != F.lit(query)).join(asked, "word").groupBy(key).agg(F.sum(F.col("w") * F.col("q")).alias("dot"))
    own = asked.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("own"))
    scored = dots.join(size(weighted), key).crossJoin(F.broadcast(own))
    return scored.select(key, (F.col("dot") / (F.col("size") * F.col("own"))).alias("score")).orderBy(F.desc(F.round("score", 12)), key).limit(k)


def nearest_to(hist: DataFrame, key: str, asked: DataFrame, k: int) -> DataFrame:
    """(key, score): the k images nearest to one that is not among them; its histogram (word, n) joins the others before TF-IDF."""
    new = "\0asked"
    both = hist.select(F.col(key).cast("string").alias(key), "word", "n").unionByName(asked.select(F.lit(new).alias(key), "word", "n"))
    return nearest(tf_idf(both, key), key, new, k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest_vectors(rows: DataFrame, key: str, vector: str, query: object, k: int) -> DataFrame:
    """(key, score): the k vectors of highest cosine with the one of the queried key, which is left out."""
    asked = rows.where(F.col(key) == F.lit(query)).select(F.col(vector).alias("_q")).limit(1)
    scored = rows.where(F.col(key) != F.lit(query)).crossJoin(F.broadcast(asked)).select(key, cosine(F.col(vector), F.col("_q")).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 12)), key).limit(k)


def all_pairs(rows: DataFrame, key: str, vector: str, least: float = -1.0) -> DataFrame:
    """(a, b, score) of all pairs a < b of cosine at least ``least``; every pair is looked at, blocks of vectors at a time. Vectors without length, and nulls, have no pairs."""
    kind = rows.schema[key].dataType.simpleString()
    rows = rows.select(F.col(key).alias("key"), F.col(vector).alias("v")).where("key is not null and v is not null and exists(v, x -> x <> 0)")
    n = rows.count()
    parts = max(1, -(-n // SIDE), min(_LEAST_BLOCKS, n // STRIP))
    block = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")
    # each vector meets every block once, in one order
    tile = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(F.least(i, block).alias("row"), F.greatest(i, block).alias("col")))
    placed = rows.withColumn("block", block).withColumn("tile", F.explode(tile)).select("key", "v", "block", "tile.row", "tile.col")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        keys, row, col, v = table.column("key").combine_chunks(), table.column("row")[0].as_py(), table.column("col")[0].as_py(), table.column("v").combine_chunks()
        if pa.compute.count_distinct(pa.compute.list_value_length(v)).as_py() > 1:
            raise ValueError("vectors of different lengths")
        x = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(keys), -1)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        block = table.column("block").to_numpy()
        left, right = np.flatnonzero(block == row), np.flatnonzero(block == col)
        # single precision leaves out what is surely too far; the rest is scored in double
        rough = x.astype(np.float32)
        other = np.ascontiguousarray(rough[right].T)
        for start in range(0, len(left), STRIP):
            some = left[start : start + STRIP]
            i, j = np.divmod(np.flatnonzero(rough[some] @ other >= np.float32(least - 1e-4)), max(1, len(right)))
            for cut in range(0, len(i), 1 << 16):
                m, n = some[i[cut : cut + (1 << 16)]], right[j[cut : cut + (1 << 16)]]
                score = np.einsum("ij,ij->i", x[m], x[n])
                a, b = keys.take(pa.array(m)), keys.take(pa.array(n))
                # within a block each pair comes both ways
                low, high = a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False)
                fine = (low < high if row == col else low != high) & (score >= least)
                swap = pa.array(low > high)
                out = pa.RecordBatch.from_arrays([pa.compute.if_else(swap, b, a), pa.compute.if_else(swap, a, b), pa.array(score)], names=["a", "b", "score"])
                yield out.filter(pa.array(fine))

    return placed.groupBy("row", "col").applyInArrow(work, f"a {kind}, b {kind}, score double")
