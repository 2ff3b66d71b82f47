"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over its
hashed words and word beginnings (inflected forms share one); the bag's probability is the noisy-or 1 - prod(1 - p). Only
document labels are needed to fit the sentence scores, by gradient descent on
the bags' likelihood. Afterwards the sentences that carry a verdict are located.

The fit uses at most ``max_train`` labelled documents (those of least hashed id), one row of
each; near copies among them share one vote, none is left out. Scoring and locating cover
every document and its whole text.

Defined cases: a null or empty text has no sentences and scores 0; a document is
toxic when its noisy-or reaches ``threshold`` and at least one sentence does so by
itself (many harmless sentences alone never condemn a long text); null labels and
labels of unknown documents are left out, of a document's several labels the toxic one counts; with no toxic or no clean label nothing
is toxic. Repeated rows are scored each on its own; in the fit the one of least text stands for rows that
repeat an id. An id that is no whole number counts as null, and its row is scored all the same. Ties: features and
documents are taken in the order of their numbers, so the fit does not depend on the order of rows. Very long texts are worked on
whole, a block each. Further columns, whatever their names, are ignored by ``train`` and ``score`` and kept by ``clean``. An empty table
gives an empty result, and no fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, blocks, keep, lists, mix, span_hashes, whole, words

BITS = 20
#: Bytes of the word beginnings that are features beside the whole word.
PREFIXES = (4, 5, 7)
KINDS = 1 + len(PREFIXES)
_ENDS = np.zeros(256, bool)
_ENDS[[10, 33, 46, 63]] = True  # newline ! . ?


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, KINDS to each word, the sentence of each, and of each sentence: document, start, end).

    A sentence ends at . ! ? or a newline and has at least one word; it reaches
    from its first word to the last byte before the next sentence's end mark.
    """
    h, doc, start, end = words(data, offsets)
    if not len(h):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    marks = np.cumsum(_ENDS[data])[start]
    new = np.r_[True, (np.diff(marks) > 0) | (np.diff(doc) > 0)]
    sent = np.cumsum(new) - 1
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(h) - 1]
    small = LOWER[data]
    kinds = [h] + [mix(span_hashes(small, start, np.minimum(start + k, end)) + np.uint64(k)) for k in PREFIXES]
    feature = (np.stack(kinds, 1) >> np.uint64(64 - BITS)).astype(np.int64)
    return feature.ravel(), np.repeat(sent, KINDS), doc[new], start[new], end[last]


def marks(feature: np.ndarray, bag: np.ndarray, n: int, hashes: int = 4) -> np.ndarray:
    """A few min-hashes of the word triples of each of n bags; a bag without triples has all ones."""
    out = np.full((n, hashes), -1, np.int64)
    feature, bag = feature[::KINDS].astype(np.uint64), bag[::KINDS]
    same = np.flatnonzero(bag[2:] == bag[:-2]) if len(bag) > 2 else np.zeros(0, np.int64)
    if len(same):
        triple = mix(feature[same] << np.uint64(2 * BITS) ^ feature[same + 1] << np.uint64(BITS) ^ feature[same + 2])
        owners, start = np.unique(bag[same], return_index=True)
        for k in range(hashes):
            out[owners, k] = np.minimum.reduceat(mix(triple + np.uint64(k << 56)), start).view(np.int64)
    return out


def votes(marks: np.ndarray) -> np.ndarray:
    """The weight of each bag: one over the number of bags in its set of near copies, so that every set has one vote. Near copies agree in all marks but one at most, themselves or through others."""
    up = np.arange(len(marks))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    has = np.flatnonzero((marks != -1).any(1))
    for left_out in range(marks.shape[1]):
        _, group = np.unique(np.delete(marks[has], left_out, 1), axis=0, return_inverse=True)
        order = np.argsort(group.ravel(), kind="stable")
        same = np.flatnonzero(np.diff(group.ravel()[order]) == 0)
        for i, j in zip(has[order[same]].tolist(), has[order[same + 1]].tolist()):
            up[top(j)] = top(i)
    heads = np.array([top(i) for i in range(len(marks))], np.int64)
    return 1 / np.bincount(heads, minlength=len(marks))[heads]


def telling(df: np.ndarray, toxic: np.ndarray, bags: float, toxic_bags: float, z: float) -> np.ndarray:
    """Features that go with the label beyond chance: root of the likelihood ratio of at least z. df, toxic: by feature, the bags and toxic bags that have it."""
    df, toxic = df.astype(float), toxic.astype(float)
    ratio = np.zeros(len(df))
    for seen, row, column in ((toxic, df, toxic_bags), (df - toxic, df, bags - toxic_bags), (toxic_bags - toxic, bags - df, toxic_bags), (bags - toxic_bags - df + toxic, bags - df, bags - toxic_bags)):
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio += np.where(seen > 1e-9, seen * np.log(seen * bags / (row * column)), 0)
    return (toxic * bags > df * toxic_bags) & (2 * ratio >= z * z)


def fit(f: np.ndarray, s: np.ndarray, bag: np.ndarray, plain: np.ndarray, label: np.ndarray, features: int, vote: np.ndarray | float = 1.0, steps: int = 150, l2: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights of the features and the bias.

    f, s: feature and sentence of each occurrence, a pair at most once; bag: of each
    of those sentences; plain: sentences of each bag that have no feature; vote: weight of each bag.
    """
    vote = np.broadcast_to(vote, len(label))
    w, m, v = np.zeros(features + 1), np.zeros(features + 1), np.zeros(features + 1)
    w[-1] = -4.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(s, w[f], len(bag)) + w[-1], -30, 30)))
        base = 1 / (1 + np.exp(-w[-1]))
        log_clean = np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-12)), len(label)) + plain * np.log1p(-base)
        toxic = np.clip(-np.expm1(log_clean), 1e-9, 1)
        pull = vote * np.where(label > 0, -(1 - toxic) / toxic, 1.0)
        g = p * pull[bag]
        grad = np.r_[np.bincount(f, g[s], features), g.sum() + base * (pull * plain).sum()] / vote.sum()
        grad[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, max_train: int = 12000, seed: int = 7, z: float = 5.0) -> tuple[np.ndarray, float]:
    """Fit on the labelled documents among docs, max_train of them at most.

    Only features that go with the toxic label beyond chance take part, so wrong
    labels move the bias and not the weights of harmless words; the screen leaves the
    sentences' scores to the fit. Features are counted by Spark, and only the
    occurrences of telling ones reach the driver.
    """
    theta = np.zeros(1 << BITS)
    known = labels.select(whole("doc_id").alias("id"), F.col("toxic").try_cast("int").alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max_train)
    # at most max_train ids are broadcast
    chosen = docs.select(whole("doc_id").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "id")
    chosen = keep(chosen.groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text")).select("y", "text", "id"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in blocks(batch.column(1)):
                feature, sent, doc, *_ = sentences(data, offsets)
                bag = doc[sent]
                pairs = np.unique(bag << BITS | feature)
                at = np.searchsorted(pairs >> BITS, np.arange(last - first + 1))
                m = marks(feature, bag, last - first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2)[first:last], batch.column(0)[first:last], lists(m.ravel(), np.arange(len(m) + 1) * m.shape[1], pa.int64()), lists(pairs & ((1 << BITS) - 1), at, pa.int32())], names=["id", "y", "marks", "features"]
                )

    bags = keep(chosen.mapInArrow(features, "id long, y int, marks array<long>, features array<int>"))
    heads = bags.select("id", "y", "marks").toArrow().sort_by("id")
    n = heads.num_rows
    ids, label = heads.column("id").to_numpy(), heads.column("y").to_numpy()
    if not n or label.min() == label.max():
        return theta, -50.0
    vote = votes(heads.column("marks").combine_chunks().flatten().to_numpy().reshape(n, -1))
    cast, toxic = float(vote.sum()), float(vote[label > 0].sum())
    fitted = docs.sparkSession.createDataFrame(pa.table({"id": ids, "vote": vote}))
    counts = bags.join(F.broadcast(fitted), "id").select(F.explode("features").alias("f"), "y", "vote").groupBy("f").agg(F.sum("vote").alias("df"), F.sum(F.when(F.col("y") > 0, F.col("vote")).otherwise(0.0)).alias("toxic"))
    # a feature with fewer votes than this cannot reach z, even if all of them are toxic
    least = z * z / (2 * np.log(cast / toxic))
    counts = counts.where((F.col("df") >= float(least) - 1e-6) & (F.col("toxic") * cast > F.col("df") * toxic)).toArrow()
    f = counts.column("f").to_numpy()[telling(counts.column("df").to_numpy(), counts.column("toxic").to_numpy(), cast, toxic, z)]
    f = np.sort(f)
    if not len(f):
        return theta, -50.0

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << BITS, bool)
        wanted[f] = True
        for batch in batches:
            for first, last, data, offsets in blocks(batch.column(1)):
                feature, sent, doc, *_ = sentences(data, offsets)
                on = np.flatnonzero(wanted[feature])
                pairs = np.unique(sent[on] << BITS | feature[on])
                s = pairs >> BITS
                at = np.searchsorted(doc[s], np.arange(last - first + 1))
                inner = s - np.searchsorted(doc, doc[s])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2)[first:last], pa.array(np.bincount(doc, minlength=last - first).astype(np.int32)), lists(pairs & ((1 << BITS) - 1), at, pa.int32()), lists(inner, at, pa.int32())], names=["id", "n", "f", "s"]
                )

    rows = chosen.mapInArrow(occurrences, "id long, n int, f array<int>, s array<int>").toArrow().sort_by("id")
    fs, ss = rows.column("f").combine_chunks(), rows.column("s").combine_chunks()
    bag = np.repeat(np.arange(rows.num_rows), np.diff(fs.offsets.to_numpy()))
    inner = ss.flatten().to_numpy()
    new = np.r_[True, (np.diff(inner) != 0) | (np.diff(bag) != 0)][: len(inner)]
    plain = rows.column("n").to_numpy() - np.bincount(bag[new], minlength=rows.num_rows)
    theta[f], bias = fit(np.searchsorted(f, fs.flatten().to_numpy()), np.cumsum(new) - 1, bag[new], plain, label, len(f), vote)
    return theta, bias


def _scores(data: np.ndarray, offsets: np.ndarray, theta: np.ndarray, bias: float) -> tuple:
    feature, sent, doc, start, end = sentences(data, offsets)
    n = len(offsets) - 1
    weight = theta[feature]
    on = np.flatnonzero(weight)
    pairs, at = np.unique(sent[on] * (1 << BITS) + feature[on], return_index=True)  # once in a sentence
    z = np.bincount(pairs >> BITS, weight[on[at]], len(doc)) + bias if len(doc) else np.zeros(0)
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return -np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n)), p, doc, start, end


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.5) -> DataFrame:
    """(doc_id, toxicity, toxic, sentence_no, sentence): the last two list the offending sentences, counted from 0."""
    theta, bias = model
    held = docs.sparkSession.sparkContext.broadcast(theta.astype(np.float32))  # 2^20 weights, whatever the input
    schema = pa.schema([("doc_id", pa.int64()), ("toxicity", pa.float64()), ("toxic", pa.int32()), ("sentence_no", pa.list_(pa.int32())), ("sentence", pa.list_(pa.string()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = held.value
        for batch in batches:
            for first, last, data, offsets in blocks(batch.column(1)):
                bag, p, doc, start, end = _scores(data, offsets, weights, bias)
                bad = np.flatnonzero(p >= threshold)
                toxic = (bag >= threshold) & (np.bincount(doc[bad], minlength=last - first) > 0)
                bad = bad[toxic[doc[bad]]]
                at = np.searchsorted(doc[bad], np.arange(last - first + 1))
                number = bad - np.searchsorted(doc, doc[bad])
                said = [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(start[bad].tolist(), end[bad].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last], pa.array(bag), pa.array(toxic.astype(np.int32)), lists(number, at, pa.int32()), lists(said, at, pa.string())], schema=schema
                )

    return docs.select(whole("doc_id").alias("doc_id"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, toxicity double, toxic int, sentence_no array<int>, sentence array<string>")


def clean(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.5) -> DataFrame:
    """The documents that are not toxic, with all their columns; no shuffle."""
    theta, bias = model
    held = docs.sparkSession.sparkContext.broadcast(theta.astype(np.float32))
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = held.value
        for batch in batches:
            good = []
            for first, last, data, offsets in blocks(batch.column(at)):
                bag, p, doc, *_ = _scores(data, offsets, weights, bias)
                good.append(~((bag >= threshold) & (np.bincount(doc[p >= threshold], minlength=last - first) > 0)))
            yield batch.filter(pa.array(np.concatenate(good))) if good else batch

    return docs.mapInArrow(work, docs.schema)
