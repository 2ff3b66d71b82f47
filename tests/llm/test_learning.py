import numpy as np

from quillspark.llm import quality, toxicity
from quillspark.llm.common import blocks
import pyarrow as pa


def test_noisy_or_finds_the_sentences(spark, odd, none):
    rng = np.random.default_rng(4)
    plain = [f"word{i}" for i in range(300)]
    bad = ["vile", "foul", "nasty"]
    rows, labels, where = [], [], {}
    for d in range(1200):
        said = [" ".join(rng.choice(plain, 8)) for _ in range(rng.integers(1, 12))]
        toxic = d % 5 == 0
        if toxic:
            at = int(rng.integers(len(said)))
            said[at] = said[at].replace(" ", f" {bad[d % 3]} ", 1)
            where[d] = at
        rows.append((d, ". ".join(said) + "."))
        labels.append((d, int(toxic) if d % 37 else int(not toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (3, None), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, max_train=800)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[d].toxic == (d in where) for d in got)
    assert all(where[d] in got[d].sentence_no and any(b in s for b in bad for s in got[d].sentence) for d in where)
    assert sorted(r.doc_id for r in toxicity.clean(docs, model).collect()) == [d for d in range(1200) if d not in where]

    rest = toxicity.score(odd, model).collect()
    assert len(rest) == odd.count() and all(r.toxic == 0 and r.sentence == [] for r in rest)
    assert {r.toxicity for r in rest if r.doc_id in (4, 5)} == {0.0}
    kept = toxicity.clean(odd, model)
    assert kept.columns == odd.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, odd.collect()))
    assert toxicity.score(none, model).count() == toxicity.clean(none, model).count() == 0
    for no in (labels.where("false"), labels.where("toxic = 1")):
        theta, bias = toxicity.train(docs, no)
        assert not theta.any() and toxicity.clean(docs, (theta, bias)).count() == 1200
    assert toxicity.train(none, labels)[1] == -50.0


def test_repeated_labelled_rows_change_nothing(spark):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for d in range(800):
        said = [" ".join(rng.choice([f"word{i}" for i in range(200)], 8)) for _ in range(rng.integers(1, 8))]
        if d % 4 == 0:
            said[-1] += " " + ("vile", "foul")[d % 8 // 4]
        rows.append((d, ". ".join(said)))
        labels.append((d, int(d % 4 == 0)))
    make = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    labels = spark.createDataFrame(labels + labels[:50], "doc_id long, toxic int")
    theta, bias = toxicity.train(make(rows), labels)
    assert np.count_nonzero(theta)
    more = rows + rows + [(d, t + " zzz vile. and other words") for d, t in rows[:300]] + [(5, None)]
    again, other = toxicity.train(make(more), labels)
    assert np.allclose(theta, again) and abs(bias - other) < 1e-9
    got = {(r.doc_id, r.toxicity) for r in toxicity.score(make(more), (theta, bias)).collect() if r.doc_id >= 300}
    assert got == {(r.doc_id, r.toxicity) for r in toxicity.score(make(rows), (theta, bias)).collect() if r.doc_id >= 300}


def test_near_copies_share_a_vote():
    a = [5, 6, 7, 8]
    marks = np.array([a, a, [5, 6, 7, 9], [5, 1, 2, 3], [-1] * 4, [-1] * 4, [5, 6, 0, 0]])
    assert toxicity.votes(marks).round(3).tolist() == [0.333, 0.333, 0.333, 1, 1, 1, 1]


def test_gradient_of_the_bags_likelihood():
    # two bags: one toxic with a telling feature, one clean without
    w, b = toxicity.fit(np.array([0]), np.array([0]), np.array([0]), np.array([2, 3]), np.array([1, 0]), 1, steps=400)
    p = 1 / (1 + np.exp(-(w[0] + b)))
    assert p > 0.95 and 1 / (1 + np.exp(-b)) < 0.05


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("pmod(xxhash64(doc_id, 1), 5) > 0"), labels.where("pmod(xxhash64(doc_id, 1), 5) = 0")
    model = toxicity.train(docs, train)
    r = toxicity.score(docs.join(test.select("doc_id"), "doc_id", "left_semi"), model).join(test.withColumnRenamed("toxic", "y"), "doc_id").select("toxic", "y").toPandas()
    assert (r[r.y == 0].toxic == 0).mean() > 0.98 and (r[r.y == 1].toxic == 1).mean() > 0.75


def test_statistics():
    texts = ["The cat sat. The cat ran!", "NOISE!! NOISE!! NOISE!!", "", "a a a a"]
    for _, _, data, offsets in blocks(pa.array(texts)):
        s = quality.statistics(data, offsets)
    assert s.shape == (4, quality.STATS) and np.isfinite(s).all() and not s[2].any()
    assert s[1, 2] == 1.0 and s[0, 2] == 2 / 18
    assert s[3, 7] == 0.75 and s[0, 7] == 0


def test_repeated_labelled_rows_of_quality(spark):
    rng = np.random.default_rng(6)
    rows = [(d, " ".join(rng.choice(["alpha", "beta", "gamma"], 30)) + ("!!!" if d % 2 else "."), "s") for d in range(600)]
    labels = spark.createDataFrame([(d, 1 - d % 2) for d in range(300)] * 2, "doc_id long, quality int")
    make = lambda x: spark.createDataFrame(x, "doc_id long, text string, source string")
    one, two = quality.train(make(rows), labels), quality.train(make(rows + rows[:100] * 3), labels)
    for model in (one, two):
        got = quality.score(make(rows), model).toPandas()
        assert (got.keep == 1 - got.doc_id % 2).mean() > 0.98


def test_cotraining(spark, odd, none):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for d in range(1500):
        good = d % 3 > 0
        text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"], 40)) + "." if good else " | ".join(rng.choice(["alpha", "beta"], 30)) + "!!"
        rows.append((d, text, "en", ("site" if rng.random() < 0.9 else "spam") if good else "spam", len(text)))
        if d < 500:
            labels.append((d, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame(labels + [(None, 0), (1, None), (10**9, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert max(model["handed"]) > 0  # pseudo-labels went from one view to the other
    got = quality.score(docs, model).toPandas()
    assert (got.keep == (got.doc_id % 3 > 0)).mean() > 0.99
    assert got[["p_text", "p_meta", "quality"]].stack().between(0, 1).all()
    assert sorted(r.doc_id for r in quality.good(docs, model).collect()) == sorted(got[got.keep == 1].doc_id)
    assert quality.score(odd, model).count() == odd.count() and set(quality.good(odd, model).columns) == set(odd.columns)
    assert quality.score(none, model).count() == quality.good(none, model).count() == 0
    bare = odd.select("text", "doc_id")
    assert quality.score(bare, model).count() == odd.count()
    for no in (labels.where("false"), labels.where("quality = 1")):
        empty = quality.train(docs, no)
        assert empty == {} and quality.good(docs, empty).count() == 1500
    assert quality.train(none, labels) == {}


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("pmod(xxhash64(doc_id, 2), 5) > 0"), labels.where("pmod(xxhash64(doc_id, 2), 5) = 0")
    got = quality.score(docs, quality.train(docs, train)).join(test.withColumnRenamed("quality", "y"), "doc_id").select("keep", "y").toPandas()
    assert (got[got.y == 1].keep == 1).mean() > 0.98 and (got[got.y == 0].keep == 0).mean() > 0.9


def test_platt_recovers_a_slope():
    rng = np.random.default_rng(0)
    z = rng.normal(size=4000)
    y = rng.random(4000) < 1 / (1 + np.exp(-(2 * z - 1)))
    a, b = quality._logistic(z[:, None], y.astype(float))
    assert abs(a - 2) < 0.2 and abs(b + 1) < 0.2
