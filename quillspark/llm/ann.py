"""Nearest neighbours by maximum inner product with score-aware (anisotropic) quantisation.

Vectors are product-quantised, two coordinates to a four-bit code. The quantiser's
loss weighs the residual's part along the vector more than the part across it, because
only the former moves the large inner products. Codebooks are fitted to a sample of at most
``max_train`` vectors (those of least hashed id); every vector is indexed. For a query, inner products with the codewords form tables of sixteen; a
scan adds up table entries by code. The exact inner products of the best ``rerank`` of a shard
give a score that the k-th best has at least; every row that may reach it, by its approximate score and the
length of its residual, is then reranked exactly. So the result is exact.

Of a shard's equal vectors only the k + 1 of least vec_id can be among the k best of any query; the others are not scanned.

Queries are the rows whose id is divisible by ``every``, and each meets all rows: shards of the data meet blocks of queries,
so that memory is bounded, and no row is left out.

Defined cases: see ``vectors.usable``; a vector is not its own neighbour; with fewer than
k others all of them are returned; equal scores rank by vec_id; other columns are
ignored, whatever their names; an empty table, or one without a query, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep
from .vectors import matrix, usable

CODES = 16
PAIR = 2
#: Rows of a data shard and of a block of queries.
SHARD, QUERIES = 16_384, 131_072
#: Rounding of sums in single precision, as a share of the vectors' lengths.
SLACK, ROUND, TINY = np.float32(1e-5), np.float32(1e-6), np.float32(1e-30)


def weight(dim: int, threshold: float = 0.2) -> float:
    """How much more the parallel residual counts for unit vectors when scores above the threshold matter."""
    return (dim - 1) * threshold**2 / (1 - threshold**2)


def _padded(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % (2 * PAIR)))).astype(np.float64)


def assign(x: np.ndarray, books: np.ndarray, eta: float, sweeps: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(codes, parallel residual): coordinate descent over the subspaces. books: subspace, code, coordinate."""
    n, m = len(x), len(books)
    parts = x.reshape(n, m, PAIR)
    norm = np.maximum((x**2).sum(1), 1e-30)
    codes = np.empty((n, m), np.int64)
    along = np.empty((n, m))  # <residual of the subspace, x>
    for j in range(m):
        d = ((parts[:, j, None] - books[j]) ** 2).sum(2)
        codes[:, j] = d.argmin(1)
        along[:, j] = ((parts[:, j] - books[j][codes[:, j]]) * parts[:, j]).sum(1)
    total = along.sum(1)
    for _ in range(sweeps):
        for j in range(m):
            others = total - along[:, j]
            r = parts[:, j, None] - books[j]
            par = (r * parts[:, j, None]).sum(2)
            loss = (r**2).sum(2) + (eta - 1) * (others[:, None] + par) ** 2 / norm[:, None]
            codes[:, j] = loss.argmin(1)
            along[:, j] = np.take_along_axis(par, codes[:, j : j + 1], 1)[:, 0]
            total = others + along[:, j]
    return codes, along


def sums(x: np.ndarray, books: np.ndarray, eta: float) -> np.ndarray:
    """Normal equations of every codeword: subspace, code, (A11, A12, A22, b1, b2, loss)."""
    m = len(books)
    parts = x.reshape(len(x), m, PAIR)
    norm = np.maximum((x**2).sum(1), 1e-30)
    codes, along = assign(x, books, eta)
    total = along.sum(1)
    out = np.zeros((m, CODES, 6))
    for j in range(m):
        p, c = parts[:, j], codes[:, j]
        w = (eta - 1) / norm
        pull = w * (total - along[:, j] + (p**2).sum(1))
        columns = (1 + w * p[:, 0] ** 2, w * p[:, 0] * p[:, 1], 1 + w * p[:, 1] ** 2, p[:, 0] * (1 + pull), p[:, 1] * (1 + pull), ((p - books[j][c]) ** 2).sum(1))
        for i, v in enumerate(columns):
            out[j, :, i] = np.bincount(c, v, CODES)
    return out


def train(rows: DataFrame, dim: int, eta: float, max_train: int, rounds: int = 6) -> np.ndarray:
    """Codebooks fitted on the driver to the vectors of least hashed id, max_train of them at most."""
    first = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_train).toArrow()
    x = _padded(matrix(first.column("v"), dim))
    x = x[np.argsort(first.column("vec_id").to_numpy())]
    m = x.shape[1] // PAIR
    some = x[:: max(1, len(x) // (64 * CODES))]
    parts = some.reshape(len(some), m, PAIR)
    start = np.random.default_rng(3)
    books = np.stack([parts[start.choice(len(some), CODES, len(some) < CODES), j] for j in range(m)])
    books = books + start.standard_normal(books.shape) * 1e-6  # so that equal points part
    for _ in range(8):  # plain k-means to begin with
        for j in range(m):
            c = ((parts[:, j, None] - books[j]) ** 2).sum(2).argmin(1)
            count = np.bincount(c, minlength=CODES)
            for i in range(PAIR):
                books[j, :, i] = np.where(count > 0, np.bincount(c, parts[:, j, i], CODES) / np.maximum(count, 1), books[j, :, i])
    for _ in range(rounds):
        s = sum(sums(x[i : i + 4096], books, eta) for i in range(0, len(x), 4096))
        a = np.stack([np.stack([s[..., 0], s[..., 1]], -1), np.stack([s[..., 1], s[..., 2]], -1)], -2)
        used = s[..., 0] > 0
        a[~used] = np.eye(PAIR)
        books = np.where(used[..., None], np.linalg.solve(a, s[..., 3:5, None])[..., 0], books)
    return books


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte."""
    return (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)


def approximate(queries: np.ndarray, codes: np.ndarray, books: np.ndarray) -> Iterator[np.ndarray]:
    """For each query the approximate inner products with all rows, in a buffer used again. codes: one byte column after the other."""
    m = len(books)
    tables = np.einsum("qjp,jcp->qjc", queries.reshape(len(queries), m, PAIR), books).astype(np.float32)
    pairs = (tables[:, 1::2, :, None] + tables[:, ::2, None, :]).reshape(len(queries), m // 2, 256)
    score, entry = np.empty(codes.shape[1], np.float32), np.empty(codes.shape[1], np.float32)
    for table in pairs:
        np.take(table[0], codes[0], out=score, mode="clip")
        for j in range(1, m // 2):
            np.take(table[j], codes[j], out=entry, mode="clip")
            score += entry
        yield score


def _best(score: np.ndarray, best: int) -> np.ndarray:
    return np.argpartition(score, len(score) - best)[len(score) - best :]


def scan(queries: np.ndarray, codes: np.ndarray, books: np.ndarray, best: int) -> np.ndarray:
    """For each query the rows of the best approximate inner products, in no order."""
    return np.stack([_best(score, best) for score in approximate(queries, codes, books)])


def residual(x: np.ndarray, codes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of x - (its codewords): the part along x as a multiple of x, and the length of the part across it."""
    r = x - np.stack([books[j][codes[:, j]] for j in range(len(books))], 1).reshape(x.shape)
    along = (r * x).sum(1) / (x**2).sum(1)
    return along, np.sqrt(((r - along[:, None] * x) ** 2).sum(1))


def reachable(score: np.ndarray, least: float, along: np.ndarray, across: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The rows whose inner product s with a unit query may be at least ``least``, by their approximate scores.

    s (1 - along) - score is the inner product of the residual across x with the query, of which the part
    across x has the length sqrt(1 - (s / |x|)^2); so score >= s (1 - along) - sqrt(1 - (s / |x|)^2) across, which rises with s >= 0.
    """
    part = np.sqrt(np.maximum(0, 1 - (least / length) ** 2) + ROUND) if least > 0 else np.float32(1)
    bound = least * (1 - along) - part * across - SLACK * (length + across + np.abs(along) * length)
    return np.flatnonzero(~(score < bound))


def unneeded(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Whether a row has at least k equal rows of smaller id."""
    key = np.ascontiguousarray(x + np.float32(0)).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()  # + 0: -0.0 equals 0.0
    same = np.unique(key, return_inverse=True)[1].ravel()
    order = np.lexsort((ids, same))
    first = np.r_[True, np.diff(same[order]) > 0]
    place = np.arange(len(ids))
    out = np.empty(len(ids), bool)
    out[order] = place - np.maximum.accumulate(np.where(first, place, 0)) >= k
    return out


def neighbours(df: DataFrame, k: int = 10, every: int = 50, rerank: int = 200, max_train: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product with each row whose id is divisible by ``every``."""
    rows, dim = usable(df, id_col, vector_col)
    schema = "query_id long, vec_id long, score double"
    none = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dim:
        return none
    rows = keep(rows)
    chosen = rows.where(F.col("vec_id") % every == 0)
    total, asked = rows.count(), chosen.count()
    if not asked:
        return none
    eta = max(1.0, weight(dim))
    books = train(rows, dim, eta, max_train)
    shards, groups = -(-total // SHARD), -(-asked // QUERIES)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _padded(matrix(batch.column(1), dim))
            codes = assign(x, books, eta)[0]
            columns = [pa.array([c.tobytes() for c in packed(codes)], pa.binary()), *map(pa.array, residual(x, codes, books))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["vec_id", "v", "codes", "along", "across"])

    spread = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    coded = keep(rows.select("vec_id", "v").mapInArrow(encode, "vec_id long, v array<float>, codes binary, along double, across double"))
    data = coded.withColumn("shard", spread(shards, "shard")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asks = chosen.withColumn("grp", spread(groups, "grp")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return none
        ask, q = left.column("vec_id").to_numpy(), matrix(left.column("v"), dim)
        ids, x = right.column("vec_id").to_numpy(), matrix(right.column("v"), dim)
        codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
        rows = np.flatnonzero(~unneeded(ids, x, k + 1))
        ids, x = ids[rows], x[rows]
        codes = np.ascontiguousarray(codes[rows].T).astype(np.intp)
        along, across = (right.column(c).to_numpy()[rows].astype(np.float32) for c in ("along", "across"))
        length = np.linalg.norm(x.astype(np.float64), axis=1).astype(np.float32)
        across[(along > 1) | (length < TINY)] = np.inf  # no bound: always reranked
        best = min(len(ids), max(rerank, k) + 1)
        out_q, out_v, out_s = [], [], []

        def exact(me: int, query: np.ndarray, near: np.ndarray) -> np.ndarray:
            s = np.einsum("d,nd->n", query, x[near].astype(np.float64))
            s[ids[near] == me] = -np.inf
            return s

        for i in range(0, len(ask), 256):
            wide = q[i : i + 256].astype(np.float64)
            norm = np.linalg.norm(wide, axis=1)
            one = wide / norm[:, None]
            for j, score in enumerate(approximate(_padded(one), codes, books)):
                me, near = ask[i + j], _best(score, best)
                s = exact(me, wide[j], near)
                if best < len(ids):
                    least = float(np.partition(s, best - k)[best - k] / norm[j])
                    near = reachable(score, least, along, across, length)
                    near = near[~(x[near] @ one[j].astype(np.float32) < least - SLACK * length[near] - TINY)]
                    s = exact(me, wide[j], near)
                order = np.lexsort((ids[near], -s))[:k]
                order = order[np.isfinite(s[order])]
                out_q.append(np.repeat(me, len(order)))
                out_v.append(ids[near[order]])
                out_s.append(s[order])
        return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})

    found = asks.select("vec_id", "v", "grp", "shard").groupBy("grp", "shard").cogroup(data.groupBy("grp", "shard")).applyInArrow(search, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 10, every: int = 50) -> str:
    """The same neighbours in SQL, scores to six places."""
    return f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= {k}"""
