"""Quality classification by co-training.

Two views of a document get a classifier each: its text (how it looks, and its words), and what
is known about the page (source, language, length). Both are additive
logistic models over binned or hashed indicators; the words of a text, hashed, count by their share of its different words. Over some rounds each labels the
unlabelled documents that it is sure of and hands them to the other. Held-out
labelled documents then calibrate each view and set how the two are combined, and
every document is scored.

The fit uses at most ``max_labelled`` labelled documents (those of least hashed id), one row of
each. The pool of unlabelled documents is the whole table: the bins' edges are quantiles over all documents, and
in each round each view hands on the ``per_round`` documents of a class that it is surest of
among all (how many are handed on in a round is the method's step, not a sample). Features of all documents are
computed once for that and kept in the checkpoint folder; a round reads them and sends those few rows to the driver.
Scoring covers every document and its whole text.

Defined cases: a null or empty text has all-zero statistics; null metadata (or a missing column) is a
value of its own; a document is kept when its combined probability of good quality
reaches ``threshold``; with labels of one class only (or none) everything is kept;
null labels and labels of unknown documents are left out, of a document's several labels the worse one counts. Repeated rows are scored
each on its own; in the fit the one of least features stands for rows that repeat a labelled id. An id that is no whole number counts as
null, and its row is scored all the same. Documents of which a view is equally sure are handed on by a hash of their features, and
all the others are in the order of their ids, so the fit does not depend on the order of rows. Very long texts are worked on whole, a block
each. Further columns, whatever their names, are ignored by ``train`` and ``score`` and kept by ``good``. An empty table gives an empty
result, and no fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, blocks, keep, lists, ragged, whole, words

STATS = 14
BINS = 12
META_SIZE = 4096
#: Buckets of hashed words, and their weight as a whole beside the indicators.
WORDS, SHARE = 4096, 3.0


def content(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(STATS content statistics of each document of a block, one row each; the buckets of its different words, with their offsets)."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)

    def per_doc(mask: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(mask)]
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    space = (data == 32) | ((data >= 9) & (data <= 13))
    symbol = ~WORD[data] & ~space
    upper = (data >= 65) & (data <= 90)
    h, doc, start, end = words(data, offsets)
    count = np.bincount(doc, minlength=n).astype(float)
    some = np.maximum(count, 1)
    same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    twice = np.zeros(n) if len(h) < 3 else np.bincount(doc[2:], (h[2:] == h[:-2]) & (doc[2:] == doc[:-2]), n)
    order = np.lexsort((h, doc))
    fresh = np.r_[True, (np.diff(h[order]) != 0) | (np.diff(doc[order]) != 0)][: len(h)]
    run = np.zeros(len(data), bool)
    if len(data) > 1:
        run[1:] = symbol[1:] & (data[1:] == data[:-1])
    bar = (data == 124) | (data == 60) | (data == 62) | (data == 123) | (data == 125)
    length = (end - start).astype(float)
    mean_length = np.bincount(doc, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(doc, length**2, n) / some - mean_length**2, 0))
    letters = np.maximum(per_doc(WORD[data]), 1)
    # the order is that of the hashes, so words of one bucket stand together
    bucket, of = (h[order] >> np.uint64(64 - 12)).astype(np.uint16), doc[order]
    first = np.flatnonzero(np.r_[True, (np.diff(bucket.astype(np.int64)) != 0) | (np.diff(of) != 0)][: len(h)])
    stats = np.stack([
        per_doc(symbol) / size, per_doc(run) / size, per_doc(upper) / letters, per_doc((data >= 48) & (data <= 57)) / size, per_doc(space) / size,
        mean_length, spread, np.bincount(doc[1:], same, n) / some if len(h) > 1 else np.zeros(n), twice / some,
        np.bincount(doc[order], fresh, n) / some / np.maximum(1, np.log2(some + 1)), per_doc(bar) / size, per_doc(data == 10) / some, per_doc(data == 33) / some, per_doc((data == 46) | (data == 44)) / some,
    ], 1)
    return stats, (bucket[first], np.searchsorted(of[first], np.arange(n + 1)))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return content(data, offsets)[0]


def _meta_code(source: object, lang: object, n_chars: object) -> list[int]:
    size = -1 if n_chars is None else int(np.log2(max(int(n_chars), 0) + 1) * 2)
    return [zlib.crc32(f"{k}={v}".encode()) % META_SIZE for k, v in (("source", source), ("lang", lang), ("size", size), ("lang-size", f"{lang} {size}"))]


def metadata(batch: pa.RecordBatch, first: int, last: int) -> np.ndarray:
    """Four hashed indicators of each row from columns 2 to 4 (source, lang, n_chars)."""
    known: dict[tuple, list[int]] = {}
    rows = zip(*(batch.column(i)[first:last].to_pylist() for i in (2, 3, 4)))
    return np.array([known[r] if r in known else known.setdefault(r, _meta_code(*r)) for r in rows], np.int64).reshape(-1, 4)


#: What a view sees of some documents: indicators, a row for each, and buckets of words with their offsets.
Sparse = tuple[np.ndarray, np.ndarray, np.ndarray]


def take(x: Sparse, rows: np.ndarray) -> Sparse:
    fixed, flat, at = x
    count = np.diff(at)[rows]
    return fixed[rows], flat[ragged(at[:-1][rows], count)], np.r_[0, np.cumsum(count)]


def joined(a: Sparse, b: Sparse) -> Sparse:
    return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.r_[a[2], b[2][1:] + a[2][-1]]


class Additive:
    """Logistic regression over indicators and words, full-batch with Adam and L2."""

    def __init__(self, size: int):
        self.w = np.zeros(size + 1)
        self.words = np.zeros(WORDS)

    def fit(self, x: Sparse, y: np.ndarray, weight: np.ndarray, steps: int = 200, l2: float = 1e-3) -> Additive:
        fixed, flat, at = x
        n, size = len(fixed), len(self.w)
        all_w = np.r_[self.w, self.words]
        m = v = np.zeros_like(all_w)
        count, total = np.diff(at), weight.sum()
        owner, part = np.repeat(np.arange(n), count), np.repeat(SHARE / np.maximum(count, 1), count)
        for t in range(1, steps + 1):
            self.w, self.words = all_w[:size], all_w[size:]
            g = (1 / (1 + np.exp(-self.score(x))) - y) * weight / total
            grad = np.r_[np.bincount(fixed.ravel(), np.repeat(g, fixed.shape[1]), size), np.bincount(flat, g[owner] * part, WORDS)]
            grad[size - 1] = g.sum()
            grad += l2 / fixed.shape[1] * np.r_[all_w[: size - 1], 0, all_w[size:]]
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            all_w = all_w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.w, self.words = all_w[:size], all_w[size:]
        return self

    def score(self, x: Sparse) -> np.ndarray:
        fixed, flat, at = x
        count = np.diff(at)
        said = np.bincount(np.repeat(np.arange(len(count)), count), self.words[flat], len(count)) / np.maximum(count, 1) if len(flat) else 0
        return np.clip(self.w[fixed].sum(1) + self.w[-1] + SHARE * said, -30, 30)


def _logistic(z: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """Coefficients and intercept of a small dense logistic regression by Newton's method, with a weak prior."""
    x = np.c_[z, np.ones(len(z))]
    w = np.zeros(x.shape[1])
    for _ in range(min(steps, 30)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        prior = np.full(len(w), 0.1)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(prior), x.T @ (p - y) + prior * w)
        w = w - step
    return w


def view(k: int, stats: np.ndarray, meta: np.ndarray, said: tuple[np.ndarray, np.ndarray], edges: np.ndarray) -> Sparse:
    """What view 0 (text) or 1 (metadata) sees."""
    return (bins(stats, edges), *said) if k == 0 else (meta, said[0][:0], np.zeros(len(meta) + 1, np.int64))


#: From (models, calibration) of both views: (view that is sure, class, statistics, metadata, words) of documents to be handed on.
Pool = Callable[[list, list], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]]


def cotrain(stats: np.ndarray, meta: np.ndarray, said: tuple[np.ndarray, np.ndarray], y: np.ndarray, edges: np.ndarray, pool: Pool, rounds: int = 4) -> dict:
    """Fit both views. y is 1 good, 0 bad; every third row is held out for calibration."""
    if not len(y) or len(np.unique(y)) < 2:
        return {}
    rows = np.arange(len(y))
    held, seen = rows[::3], np.setdiff1d(rows, rows[::3])
    if len(np.unique(y[held])) < 2 or len(np.unique(y[seen])) < 2:
        held = seen = rows
    views, sizes = [view(k, stats, meta, said, edges) for k in range(2)], (STATS * BINS, META_SIZE)
    own = [(take(x, seen), y[seen].astype(float), np.ones(len(seen))) for x in views]  # training rows of each view, targets, weights
    models, calibration, handed = [None, None], [None, None], [0, 0]
    for r in range(rounds + 1):
        for k, x in enumerate(views):
            # later rounds go on from the weights of the one before
            models[k] = Additive(sizes[k]).fit(*own[k]) if r == 0 else models[k].fit(*own[k], steps=60)
            calibration[k] = _logistic(models[k].score(take(x, held))[:, None], y[held])
        if r == rounds:
            break
        sure, cls, s, m, w = pool(models, calibration)
        for k in range(2):
            mine = np.flatnonzero(sure == 1 - k)
            handed[k] += len(mine)
            x, target, weight = own[k]
            own[k] = joined(x, take(view(k, s, m, w, edges), mine)), np.r_[target, cls[mine]], np.r_[weight, np.full(len(mine), 0.5)]
        if not len(sure):
            break
    both = np.stack([a * m.score(take(x, held)) + b for (a, b), m, x in zip(calibration, models, views)], 1)
    return {"edges": edges, "models": models, "calibration": calibration, "combine": _logistic(both, y[held]), "handed": handed}


def bins(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[:, j], stats[:, j], "right") + j * BINS for j in range(stats.shape[1])], 1)


def predict(model: dict, data: np.ndarray, offsets: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of good quality by text, by metadata, and combined, of the documents of a block."""
    if not model:
        one = np.ones(len(offsets) - 1)
        return one, one, one
    stats, said = content(data, offsets)
    stats = stats.astype(np.float32).astype(float)  # as they are kept for the fit
    z = np.stack([a * m.score(view(k, stats, meta, said, model["edges"])) + b for k, ((a, b), m) in enumerate(zip(model["calibration"], model["models"]))], 1)
    total = z @ model["combine"][:-1] + model["combine"][-1]
    return tuple(1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in (z[:, 0], z[:, 1], total))


def _columns(docs: DataFrame) -> list:
    there = set(docs.columns)
    kinds = {"source": "string", "lang": "string", "n_chars": "long"}
    return [whole("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"), *((F.col(c) if c in there else F.lit(None)).try_cast(k).alias(c) for c, k in kinds.items())]


def _unpacked(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<u2"), np.r_[0, np.cumsum([len(r) // 2 for r in raw])].astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000, per_round: int = 400, sure: float = 0.97, seed: int = 11) -> dict:
    """Co-train on the labelled documents of docs and all others. sure: the certainty from which a document is handed on."""
    known = labels.select(whole("doc_id").alias("id"), F.col("quality").try_cast("int").alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max_labelled)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in blocks(batch.column(1)):
                (s, (said, at)), m = content(data, offsets), metadata(batch, first, last)
                n, raw, at = np.arange(last - first + 1), said.astype("<u2").tobytes(), (at * 2).tolist()
                w = pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], lists(s.ravel(), n * STATS, pa.float32()), lists(m.ravel(), n * 4, pa.int32()), w], names=["id", "s", "m", "w"])

    # at most max_labelled ids are broadcast
    known = F.broadcast(keep(known))
    all_rows = keep(docs.select(*_columns(docs)).mapInArrow(features, "id long, s array<float>, m array<int>, w binary"))
    rows = all_rows.join(known, "id").groupBy("id").agg(F.max("y").alias("y"), F.min(F.struct("s", "m", "w")).alias("x")).select("id", "y", "x.s", "x.m", "x.w").toArrow().sort_by("id")
    if not rows.num_rows:
        return {}
    cuts = [k / BINS for k in range(1, BINS)]
    edges = np.array(all_rows.agg(*(F.percentile_approx(F.col("s")[i], cuts, 10_000).alias(str(i)) for i in range(STATS))).first()).T.astype(float)
    rest = all_rows.join(known, "id", "left_anti").select(F.xxhash64("id", "s", "m").alias("h"), "s", "m", "w")
    taken: list[list[int]] = [[], []]  # hashes of what each view has been handed

    def pool(models: list, calibration: list) -> tuple:
        done = [np.array(sorted(t), np.int64) for t in taken]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h, s, m = batch.column(0).to_numpy(), *(batch.column(i).flatten().to_numpy().reshape(len(batch), -1) for i in (1, 2))
                said = _unpacked(batch.column(3))
                for k in range(2):
                    x = view(k, s.astype(float), m.astype(np.int64), said, edges)
                    (a, b), fresh = calibration[k], ~np.isin(h, done[1 - k])
                    p = 1 / (1 + np.exp(-np.clip(a * models[k].score(x) + b, -30, 30)))
                    for cls, certainty in ((1, p), (0, 1 - p)):
                        at = np.flatnonzero(fresh & (certainty >= sure))
                        at = at[np.lexsort((h[at], -certainty[at]))][:per_round]
                        some = pa.array(at)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(np.full(len(at), cls, np.int32)), pa.array(certainty[at]), *(batch.column(i).take(some) for i in range(4))], names=["view", "cls", "certainty", "h", "s", "m", "w"])

        best = F.row_number().over(Window.partitionBy("view", "cls").orderBy(F.desc("certainty"), "h"))
        got = rest.mapInArrow(work, "view int, cls int, certainty double, h long, s array<float>, m array<int>, w binary").dropDuplicates(["view", "cls", "h"])
        got = got.withColumn("best", best).where(F.col("best") <= per_round).toArrow().sort_by([("view", "ascending"), ("cls", "ascending"), ("best", "ascending")])
        n, which, h = got.num_rows, got.column("view").to_numpy(), got.column("h").to_numpy()
        for k in range(2):
            taken[1 - k] += h[which == k].tolist()
        s, m = (got.column(c).combine_chunks().flatten().to_numpy().reshape(n, k) for c, k in (("s", STATS), ("m", 4)))
        return which, got.column("cls").to_numpy(), s.astype(float), m.astype(np.int64), _unpacked(got.column("w"))

    n = rows.num_rows
    flat = lambda c, k: rows.column(c).combine_chunks().flatten().to_numpy().reshape(n, k)
    return cotrain(flat("s", STATS).astype(float), flat("m", 4).astype(np.int64), _unpacked(rows.column("w")), rows.column("y").to_numpy(), edges, pool)


def score(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_text, p_meta, quality, keep) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in blocks(batch.column(1)):
                a, b, p = predict(held.value, data, offsets, metadata(batch, first, last))
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array(a), pa.array(b), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "p_text", "p_meta", "quality", "keep"])

    return docs.select(*_columns(docs)).mapInArrow(work, "doc_id long, p_text double, p_meta double, quality double, keep int")


def good(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The documents kept, with all their columns; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    n, longest, text = len(docs.columns), max(map(len, docs.columns)), docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = pa.RecordBatch.from_arrays([pa.nulls(len(batch)), batch.column(text), *batch.columns[n:]], names=["a", "b", "c", "d", "e"])
            ok = [predict(held.value, d, o, metadata(seen, i, j))[2] >= threshold for i, j, d, o in blocks(seen.column(1))]
            out = batch.select(list(range(n)))
            yield out.filter(pa.array(np.concatenate(ok))) if ok else out

    about = [c.alias(f"seen{'_' * longest}{i}") for i, c in enumerate(_columns(docs)[2:])]  # no column's names
    return docs.select("*", *about).mapInArrow(work, docs.schema)
