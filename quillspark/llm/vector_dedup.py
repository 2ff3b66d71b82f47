"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance t = 2 (1 - c). After a
random rotation the coordinates are split into blocks; with t shared out in
proportion to the blocks' dimensions, at least one block of a similar pair is within
its share. Each block is range-joined by itself on a grid: a vector has one home
cell and probes the cells of higher number that its ball reaches (of two vectors in different
cells the one in the lower reaches the other's). The union of the candidates,
screened by the distance of coarse copies that the postings carry (with its error
allowed for), is verified on the exact vectors.

Vectors that agree in the signs of a few random projections are first compared with the least
among them, and put together in cores where they are similar. All pairs of a core are
counted in blocks, in the task; the join above returns only pairs of different cores. So a group of k near
copies costs no k * k rows, and no link is lost.

Defined cases: see ``vectors.usable``; an id whose vectors are not usable is a class of its own; equal vectors
are represented by the least vec_id among them; cosines of exactly the threshold (as computed) are links; a class is named after its
least vec_id; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, whole
from .cores import classified, cores, leaders, placed, tiles
from .vectors import matrix, unit, usable

#: Vectors that one grid cell should hold on average; and of a core's part.
CELL, PART = 1024, 4096
STEP = 1 / 127
#: Bits of a sketch, and sketches of a vector.
SIGNS, SKETCH = 24, 6


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def cells(x: np.ndarray, radius: float, axes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home cell of each row, and (row, cell) of the other cells within radius of it), over the first axes coordinates."""
    width = 2 * radius
    base = np.floor(x[:, :axes] / width).astype(np.int64)
    at = x[:, :axes] - base * width
    code = lambda c: sum(((c[:, a] + 128) & 255) << (8 * a) for a in range(axes))
    near = np.where(at < radius, -1, 1)  # the ball reaches beyond one side of each axis
    gap = np.minimum(at, width - at)
    rows, found = [], []
    for turn in itertools.product((False, True), repeat=axes):
        t = np.array(turn)
        if t.any():
            reach = np.flatnonzero((gap[:, t] ** 2).sum(1) <= radius**2 * (1 + 1e-9))
            rows.append(reach)
            found.append(code(base[reach] + near[reach] * t))
    return code(base), np.concatenate(rows), np.concatenate(found)


def _cell_pairs(dim: int, block: int, radius: float, limit: float):  # noqa: ANN202
    slack = STEP / 2 * 2
    near, far = np.float32((radius + slack * math.sqrt(block)) ** 2 + 1e-5), (math.sqrt(limit) + slack * math.sqrt(dim)) ** 2 + 1e-5

    def work(table: pa.Table) -> pa.Table:
        ids, core = table.column("doc_id").to_numpy(), table.column("core").to_numpy()
        home = table.column("home").to_numpy(zero_copy_only=False).astype(bool)
        which, row, col = (table.column(c)[0].as_py() for c in ("block", "row", "col"))
        coarse = np.frombuffer(b"".join(table.column("coarse").to_pylist()), np.int8).reshape(-1, dim).astype(np.float32) * np.float32(STEP)
        part = coarse[:, which * block : (which + 1) * block]
        norms, one = (part**2).sum(1, keepdims=True), np.ones((len(part), 1), np.float32)
        # the product of a left and a right row is their squared distance in this block
        left, right = np.hstack([part, norms, one]), np.ascontiguousarray(np.hstack([-2 * part, one, norms]).T)
        h, p = np.flatnonzero(home), np.flatnonzero(~home)
        if row == col:
            meets = [(h, h), (h, p)]
        else:
            side = table.column("part").to_numpy()[h]
            meets = [(h[side == row], h[side == col])]
        out_a, out_b = [], []
        for a, b in meets:
            for i in range(0, len(a), 256):
                ai = a[i : i + 256]
                for j in range(i if a is b else 0, len(b), 1024):
                    bj = b[j : j + 1024]
                    s, t = np.nonzero(left[ai] @ right[:, bj] <= near)
                    s, t = ai[s], bj[t]
                    ok = (core[s] != core[t]) & ((s < t) if a is b else True)
                    s, t = s[ok], t[ok]
                    for k in range(0, len(s), 1 << 14):
                        x, y = s[k : k + (1 << 14)], t[k : k + (1 << 14)]
                        ok = ((coarse[x] - coarse[y]) ** 2).sum(1) <= far
                        out_a.append(np.minimum(ids[x[ok]], ids[y[ok]]))
                        out_b.append(np.maximum(ids[x[ok]], ids[y[ok]]))
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *out_a]), "b": np.concatenate([none, *out_b])})

    return work


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of two matrices."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


def _similar(pairs: DataFrame, vectors: DataFrame, dim: int, cosine: float) -> DataFrame:
    """Those of the pairs (a, b) whose vectors are similar."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = _cosines(matrix(batch.column(2), dim), matrix(batch.column(3), dim)) >= cosine
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    side = lambda x: vectors.select(F.col("doc_id").alias(x), F.col("v").alias(f"v{x}"))
    return keep(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "va", "vb").mapInArrow(work, "a long, b long"))


def _core_links(dim: int, cosine: float):  # noqa: ANN202
    """Numbers of links within the cores of a group, by blocks of products."""

    def work(table: pa.Table) -> pa.Table:
        ids, core, part, row, col = (table.column(c).to_numpy() for c in ("doc_id", "core", "part", "row", "col"))
        x, order = unit(matrix(table.column("v"), dim)), np.argsort(core, kind="stable")
        links = np.zeros(len(ids), np.int64)
        start = np.flatnonzero(np.r_[True, np.diff(core[order]) != 0])
        for s, e in zip(start.tolist(), np.r_[start[1:], len(order)].tolist()):
            these = order[s:e]
            cross = row[these[0]] != col[these[0]]
            for i in range(0, len(these), 1024):
                a = these[i : i + 1024]
                for j in range(0, len(these), 4096):
                    b = these[j : j + 4096]
                    like = x[a] @ x[b].T >= cosine
                    if cross:
                        like &= part[a][:, None] != part[b]
                    links[a] += like.sum(1) - (0 if cross else np.isin(a, b) & ((x[a] ** 2).sum(1) >= cosine))
        return pa.table({"doc_id": ids, "links": links})

    return work


def near_classes(df: DataFrame, cosine: float = 0.95, block: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, class_id, links): one row for each vec_id.

    links is the number of other vectors with a cosine of at least the threshold (equal vectors have the same links,
    and are none to each other); a class is what such links and equal vectors connect, class_id the least vec_id in it.
    """
    everyone = df.select(whole(id_col).alias("doc_id")).where("doc_id is not null").distinct()
    rows, dim = usable(df, id_col, vector_col)
    if not dim:
        return everyone.select(F.col("doc_id").alias("vec_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    rows = keep(rows.withColumnRenamed("vec_id", "doc_id"))
    least = rows.groupBy("v").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = keep(rows.join(least, "v").where("doc_id <> rep").select("doc_id", "rep"))
    reps = keep(rows.join(copies.select("doc_id"), "doc_id", "left_anti"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(9).standard_normal((dim, SIGNS * SKETCH))
        for batch in batches:
            bits = (unit(matrix(batch.column(1), dim)) @ planes > 0).reshape(-1, SKETCH, SIGNS)
            keys = (bits << np.arange(SIGNS)).sum(2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys.tolist(), pa.list_(pa.int64()))], names=["doc_id", "keys"])

    core = cores(_similar(leaders(reps.select("doc_id", "v").mapInArrow(sketched, "doc_id long, keys array<long>")), reps, dim, cosine))
    within = placed(reps.withColumn("mass", F.lit(1)), core, "mass", PART).groupBy("grp").applyInArrow(_core_links(dim, cosine), "doc_id long, links long")
    within = keep(within.groupBy("doc_id").agg(F.sum("links").alias("links")))

    limit = 2 * (1 - cosine)
    block = min(block, dim, 8)  # a cell is named in 64 bits, 8 for each axis
    blocks = -(-dim // block)
    axes = max(1, min(block, dim % block or block, math.ceil(math.log(max(1, reps.count() / CELL)) / math.log(3))))
    turn = rotation(dim)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 1000):
                ids, core = (batch.column(k)[i : i + 1000] for k in (0, 2))
                x = unit(matrix(batch.column(1)[i : i + 1000], dim)) @ turn
                coarse = np.rint(x / STEP).astype(np.int8)
                coarse = pa.array([c.tobytes() for c in coarse], pa.binary())
                for b in range(blocks):
                    part = x[:, b * block : (b + 1) * block]
                    own, row, cell = cells(part, math.sqrt(limit * part.shape[1] / dim), axes)
                    up = cell > own[row]
                    row, cell = np.r_[np.arange(len(own)), row[up]], np.r_[own, cell[up]]
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), b, np.int32)), pa.array(cell), pa.array(np.arange(len(row)) < len(own)), ids.take(take), core.take(take), coarse.take(take)],
                        names=["block", "cell", "home", "doc_id", "core", "coarse"],
                    )

    posted = reps.join(core, "doc_id", "left").select("doc_id", "v", F.coalesce("core", "doc_id").alias("core")).mapInArrow(post, "block int, cell long, home boolean, doc_id long, core long, coarse binary")
    # a crowded cell is cut up: its residents are spread over parts that meet in pairs, and each part gets all of the cell's probes once
    crowded = keep(posted.where("home").groupBy("block", "cell").count().where(F.col("count") > 4 * CELL).select("block", "cell", F.ceil(F.col("count") / (4 * CELL)).cast("int").alias("parts")))
    posted = posted.join(crowded, ["block", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    probed = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(i.alias("row"), i.alias("col")))
    posted = posted.withColumn("tile", F.explode(F.when(F.col("home"), tiles("parts", "part")).otherwise(probed))).select("block", "cell", "home", "doc_id", "core", "coarse", "part", "tile.row", "tile.col")
    radius = math.sqrt(limit * block / dim)  # a last, shorter block has a smaller one; this only admits more
    found = keep(posted.groupBy("block", "cell", "row", "col").applyInArrow(_cell_pairs(dim, block, radius, limit), "a long, b long").distinct())
    out = classified(everyone, reps, copies, core, within, _similar(found, reps, dim, cosine))
    return out.select(F.col("doc_id").alias("vec_id"), "class_id", "links")


def oracle(cosine: float = 0.95) -> str:
    """The same rows in SQL by comparing all pairs."""
    return f"""
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v, min(vec_id) OVER (PARTITION BY embedding) AS rep FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS cosine FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id = a.rep AND b.vec_id = b.rep),
d AS (SELECT a, b FROM p WHERE cosine >= {cosine}),
c AS (SELECT DISTINCT a AS vec_id, a AS top FROM d UNION SELECT d.b, c.top FROM c JOIN d ON c.vec_id = d.a WHERE c.top < d.b),
k AS (SELECT vec_id, min(top) AS top FROM c GROUP BY 1),
m AS (SELECT a AS vec_id, count(*) AS links FROM d GROUP BY 1)
SELECT i.vec_id, coalesce(k.top, e.rep, i.vec_id) AS class_id, coalesce(m.links, 0)::BIGINT AS links
FROM (SELECT DISTINCT vec_id FROM embeddings WHERE vec_id IS NOT NULL) i LEFT JOIN e ON e.vec_id = i.vec_id LEFT JOIN k ON k.vec_id = e.rep LEFT JOIN m ON m.vec_id = e.rep"""
