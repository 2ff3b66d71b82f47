import numpy as np
import pytest

from quillspark.llm import ann, cores, ngram_join, vector_dedup
from quillspark.llm.graph import components
from quillspark.llm.vectors import unit, usable


def word_sets(rows, n=ngram_join.N):
    import re

    out = {}
    for i, t in rows:
        if i is None or t is None:
            continue
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.translate({c: c + 32 for c in range(65, 91)}))
        if w:
            g = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1)))
            out[i] = g
    return out


def brute(rows, threshold=ngram_join.THRESHOLD):
    """(doc_id, class, links) by comparing all different sets."""
    sets, reps = word_sets(rows), {}
    rep = {i: reps.setdefault(sets[i], i) for i in sorted(sets)}
    ids, links = sorted(reps.values()), dict.fromkeys(sets, 0)
    up = {i: rep.get(i, i) for i, _ in rows if i is not None}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            c = len(sets[a] & sets[b])
            if c / (len(sets[a]) + len(sets[b]) - c) >= threshold:
                links[a], links[b] = links[a] + 1, links[b] + 1
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return sorted((i, top(i), links.get(rep.get(i, i), 0)) for i in up)


SIZES = {"MASS": (2_000, 150), "CHUNK": (3_000, 500), "PART": (1_500, 100), "POSTED": (300, 50), "CROWD": (16, 4), "LEVEL": (11, 2), "SKETCH": (2, 1)}


@pytest.mark.parametrize("scale", [None, 0, 1])
def test_join_against_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(cores, "STAR", 1000 if scale is None else 5)
    for name, small in SIZES.items() if scale is not None else ():  # several fragments of every kind, cores in parts, crowded n-grams, cuts in two steps
        monkeypatch.setattr(ngram_join, name, small[scale])
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choice(words, 30))
    rows = []
    for d in range(60):
        rows.append((len(rows), " ".join(rng.choice(words, rng.integers(1, 120))) + (" " + shared if d % 3 == 0 else "")))
    for d in range(0, 60):
        base = rows[d % 4][1].split()
        for _ in range(rng.integers(0, 9)):
            base[rng.integers(len(base))] = str(rng.choice(words))
        rows.append((len(rows), " ".join(base)))
    rows += [(len(rows) + k, rows[3][1]) for k in range(5)]
    rows += [(900, None), (901, ""), (902, "..."), (903, "Hi there"), (904, "hi, THERE"), (905, "hi")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got, want = sorted(map(tuple, ngram_join.join(docs).collect())), brute(rows)
    assert got == want and sum(n for *_, n in got) > 300
    assert {r.doc_id for r in ngram_join.one_of_each(docs).collect()} == {i for i, c, _ in want if i == c}


def test_join_of_many_short_documents(spark, monkeypatch):
    for name, small in SIZES.items():
        monkeypatch.setattr(ngram_join, name, small[1])
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(30)]
    rows = []
    for d in range(90):
        text = list(base)
        for _ in range(d % 5):
            text[rng.integers(len(text))] = f"x{rng.integers(40)}"
        rows.append((d * 3, " ".join(text[rng.integers(0, 8) :])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, ngram_join.join(docs).collect()))
    assert got == brute(rows) and sum(n for *_, n in got) > 1000


def test_links_within_blocks():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(70)]
    size, part = np.array([len(s) for s in sets]), np.arange(70) % 2
    like = np.array([[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.3 for b in sets] for a in sets]) & ~np.eye(70, dtype=bool)
    one = lambda row, col: ngram_join.links_within(np.arange(70), size, part, sets, 0.3, row, col, side=16, span=8).tolist()
    assert one(0, 0) == like.sum(1).tolist() and like.sum() > 100
    assert one(0, 1) == (like & (part[:, None] != part)).sum(1).tolist()


def test_join_finds_copies_with_a_tenth_of_the_words_changed(spark):
    rows = []
    for d, size in enumerate((50, 100, 200, 1000)):
        text = [f"d{d}w{i}" for i in range(size)]
        rows.append((2 * d, " ".join(text)))
        rows.append((2 * d + 1, " ".join(f"x{i}" if i % 10 == 5 else w for i, w in enumerate(text))))
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(i, i - i % 2, 1) for i in range(8)]


def test_join_of_odd_documents(spark, odd, none):
    got = sorted(map(tuple, ngram_join.join(odd).collect()))
    assert got == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert (2, 1, 1) in got and (3, 1, 1) in got
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 1
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 4, 5, 6, 7, 8, 9]  # one of the two rows of 8
    assert ngram_join.join(none).count() == ngram_join.one_of_each(none).count() == 0
    named = spark.createDataFrame([("7", "a b c", 1), ("x", "a b c", 2), ("3", "a b c", 3)], "doc_id string, text string, __gone int")
    assert sorted(map(tuple, ngram_join.join(named).collect())) == [(3, 3, 0), (7, 3, 0)]
    assert sorted(r.doc_id for r in ngram_join.one_of_each(named).collect()) == ["3", "x"]


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 7), (7, 6), (20, 21), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: 1 for n in (1, 2, 3)} | {n: 6 for n in range(6, 11)} | {20: 20, 21: 20} | {n: 100 for n in range(100, 141)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 24))
    near = x[:80] + rng.standard_normal((80, 24)) * rng.uniform(0.01, 0.4, (80, 1))
    cluster = x[:1] + rng.standard_normal((40, 24)) * 0.15
    m = np.concatenate([x, near, cluster, x[5:8], x[5:6] * 3]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(2000, None), (2001, [0.0] * 24), (2002, [1.0]), (2003, [float("nan")] * 24), (None, m[0].tolist()), (3, m[3].tolist())]
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, a int, v int").repartition(3), m


@pytest.mark.parametrize("cell", [1024, 8])
def test_near_classes_against_brute_force(spark, vectors, monkeypatch, cell):
    monkeypatch.setattr(vector_dedup, "CELL", cell)  # small cells: more axes, and crowded ones are cut up
    monkeypatch.setattr(vector_dedup, "PART", cell)
    monkeypatch.setattr(vector_dedup, "SKETCH", 6 if cell > 8 else 1)
    df, m = vectors
    got = sorted(map(tuple, vector_dedup.near_classes(df, cosine=0.93).collect()))
    u = unit(m)
    like = u @ u.T >= 0.93
    first, rep = {}, {}
    for i, v in enumerate(m):
        rep[i] = first.setdefault(v.tobytes(), i)
    reps = sorted(first.values())
    up, links = dict(rep), dict.fromkeys(reps, 0)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in reps:
        for b in reps:
            if a < b and like[a, b]:
                links[a], links[b] = links[a] + 1, links[b] + 1
                x, y = sorted((top(a), top(b)))
                up[y] = x
    want = [(i, top(i), links[rep[i]]) for i in rep] + [(i, i, 0) for i in range(2000, 2004)]
    assert got == sorted(want) and sum(links.values()) > 400
    none = df.where("false")
    assert vector_dedup.near_classes(none).count() == ann.neighbours(none).count() == 0
    assert sorted(map(tuple, vector_dedup.near_classes(df.where("vec_id >= 2000")).collect())) == [(i, i, 0) for i in range(2000, 2004)]


def test_usable(vectors):
    rows, dim = usable(vectors[0])
    assert dim == 24 and rows.count() == len(vectors[1])


def test_cells_cover_the_ball():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 3)) * 0.2
    home, row, cell = vector_dedup.cells(x, 0.1, 3)
    probes = set(zip(row.tolist(), cell.tolist())) | set(enumerate(home.tolist()))
    for i in range(300):
        for j in np.flatnonzero(((x - x[i]) ** 2).sum(1) <= 0.01):
            assert (i, int(home[j])) in probes


def test_neighbours_recall_and_ties(spark, vectors):
    df, m = vectors
    got = {}
    for r in ann.neighbours(df, k=10, rerank=60, every=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    s = m.astype(float) @ m.astype(float).T
    np.fill_diagonal(s, -np.inf)
    assert set(got) == set(range(0, len(m), 3))
    hits = 0
    for i, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        assert all(abs(v - s[i, j]) < 1e-4 for _, j, v in rows) and rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        hits += len({r[1] for r in rows} & set(np.argsort(-s[i], kind="stable")[:10].tolist()))
    assert hits / (10 * len(got)) >= 0.9
    few = ann.neighbours(df.where("vec_id < 4"), k=10, every=1).collect()
    assert len(few) == 12 and all(r.query_id != r.vec_id for r in few)
    assert ann.neighbours(df.where("vec_id in (1, 2)"), every=50).count() == 0  # no query among them


def test_neighbours_within_large_groups_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((2, 16))
    near = centre[:1] + rng.standard_normal((2000, 16)) * 1e-3
    m = np.concatenate([rng.standard_normal((500, 16)), near, np.repeat(centre[1:], 400, 0)]).astype(np.float32)
    m = m[rng.permutation(len(m))]
    monkeypatch.setattr(ann, "SHARD", 1000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in ann.neighbours(df, k=10, every=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    wide = m.astype(float)
    for i in range(0, len(m), 7):
        s = np.einsum("d,nd->n", wide[i], wide)
        s[i] = -np.inf
        assert got[i] == np.argsort(-s, kind="stable")[:10].tolist()


def test_anisotropic_loss_falls():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    eta = 4.0
    books = np.stack([x.reshape(2000, 8, 2)[rng.choice(2000, 16, False), j] for j in range(8)])

    def loss(books):
        codes, along = ann.assign(x, books, eta)
        back = np.stack([books[j][codes[:, j]] for j in range(8)], 1).reshape(2000, 16)
        return (((x - back) ** 2).sum(1) + (eta - 1) * ((x - back) * x).sum(1) ** 2).mean()

    before = loss(books)
    for _ in range(4):
        s = ann.sums(x, books, eta)
        a = np.stack([np.stack([s[..., 0], s[..., 1]], -1), np.stack([s[..., 1], s[..., 2]], -1)], -2)
        books = np.linalg.solve(a + np.eye(2) * 1e-12, s[..., 3:5, None])[..., 0]
    assert loss(books) < 0.8 * before


def test_scan_adds_up_the_tables():
    rng = np.random.default_rng(2)
    books, q = rng.standard_normal((8, 16, 2)), rng.standard_normal((5, 16))
    codes = rng.integers(0, 16, (300, 8))
    near = ann.scan(q, np.ascontiguousarray(ann.packed(codes).T).astype(np.intp), books, 20)
    back = np.stack([books[j][codes[:, j]] for j in range(8)], 1).reshape(300, 16)
    want = np.argsort(-(q @ back.T), axis=1)[:, :20]
    assert all(set(a) == set(b) for a, b in zip(near.tolist(), want.tolist()))
