import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions.analysis import bag_of_words
from quillspark.functions.stemming import english, spanish
from quillspark.functions.types import SqlType, cut_bytes, from_text
from quillspark.errors import Invalid
from quillspark.operators import layouts, spatial, text, vision
from quillspark.sources.generate import random_rows
from quillspark.sources.storage import last_of_each, read_csv, read_images


def test_english_stems():
    # examples of the published description of the algorithm
    pairs = "consist consistency:consist consisted:consist consistently:consist knightly:knight knives:knive knots:knot skies:sky dying:die running:run hopping:hop hoped:hope flies:fli tied:tie gas:gas this:this news:news generously:generous national:nation relational:relat conditional:condit vileness:vile agreed:agre sensational:sensat happy:happi say:say"
    for pair in pairs.split():
        word, _, stem = pair.partition(":")
        assert english(word) == (stem or word), word


def test_spanish_stems():
    for pair in "cheques:chequ checando:chec chicharrones:chicharron chica:chic torneado:torn torneos:torne tornillo:tornill torre:torr torrencial:torrencial rápidamente:rapid nacionalidad:nacional dándole:dandol cantándole:cant".split():
        word, _, stem = pair.partition(":")
        assert spanish(word) == stem, word


@pytest.mark.parametrize("text,n", [("12345678901234567890123", 20), ("12345678901234567890123", 5), ("añoño", 2), ("añoño", 3), ("日本語", 4), ("日本語", 5), ("日本語", 6), ("a😀b", 4), ("a😀b", 5), ("", 3), ("ab", 3)])
def test_cut_bytes(spark, text, n):
    got = spark.range(1).select(cut_bytes(F.lit(text), n).alias("x")).first().x
    assert got == text.encode()[:n].decode(errors="ignore")


def test_types(spark):
    one = lambda v, t: spark.range(1).select(from_text(F.lit(v), SqlType.parse(t)).alias("x")).first().x
    assert one("18446744073709551615", "ulong") == 2**64 - 1 and one("-2147483648", "int") == -(2**31) and one("9223372036854775807", "long") == 2**63 - 1
    assert one("2147483648", "int") is None and one("1", "bool") is True and one("0", "bool") is False and one("maybe", "bool") is None
    assert str(one("2024-01-02T03:04:05", "timestamp")) == str(one("2024-01-02 03:04:05", "timestamp")) == "2024-01-02 03:04:05"
    assert str(SqlType.parse("VARCHAR[7]")) == "varchar[7]"
    for bad in ("varchar", "int[3]", "blob"):
        with pytest.raises(Invalid):
            SqlType.parse(bad)


def test_bag_counts_lemma_and_stem(spark):
    df = spark.createDataFrame([(1, "The runners running, RUN!"), (2, None)], "id int, t string")
    plain = {(r.id, r.term): r.tf for r in bag_of_words(df, "id", "t").collect()}
    assert plain == {(1, "the"): 1, (1, "runners"): 1, (1, "running"): 1, (1, "run"): 1}
    stemmed = {(r.id, r.term): r.tf for r in bag_of_words(df, "id", "t", "english").collect()}
    assert stemmed == {(1, "runners"): 1, (1, "runner"): 1, (1, "running"): 1, (1, "run"): 3}


def test_stemmed_bag_reads_texts_once(spark):
    df = spark.createDataFrame([(1, "The runners running, RUN!"), (2, "runs ran"), (None, "boats"), (3, None)], "id int, t string")
    bag = lambda rows, **k: bag_of_words(rows, "id", "t", "english", **k)
    found = bag(df)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    rows = lambda b: sorted(map(repr, map(tuple, b.collect())))
    assert rows(found) == rows(bag(df, unique=None)) == rows(bag(df, lemma=lambda c: c))
    twice = df.union(df)
    assert rows(bag(twice, unique=None)) == rows(bag(twice)) == rows(bag(twice, lemma=lambda c: c)) != rows(found)


def test_words_of_a_text_are_those_of_the_expression(spark):
    from quillspark.functions.analysis import terms, words_of

    texts = ["The CAT's  hat—x2y", "", "ÉTÉ çà ½ Ⅷ ² 日本語 ñandú\n_a_", "ſß ﬁ Σίσυφος 😀a"]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(terms(F.col("t")).alias("x")).collect()]
    assert [[w for w in words_of(t) if w] for t in texts] == got
    twice = spark.createDataFrame([(1, "a b"), (1, "a"), (None, "c"), (2, None)], "id int, t string")
    assert sorted(map(repr, map(tuple, bag_of_words(twice, "id", "t").collect()))) == sorted(["(1, 'a', 2)", "(1, 'b', 1)", "(None, 'c', 1)"])


def test_pixels_and_gradients():
    grey = b"P5 4 2 255\n" + bytes(range(8))
    image = vision.pixels(grey)
    assert image.shape == (2, 4) and image[1, 3] == 7 / 255
    assert vision.pixels(b"P6\n1 1\n255\n\xff\xff\xff")[0, 0] == pytest.approx(1)
    with pytest.raises(ValueError):
        vision.pixels(b"GIF89a")
    assert np.allclose(vision.resize(image, 4, 2), image) and vision.resize(np.full((5, 7), 0.5), 3, 9).tolist() == np.full((9, 3), 0.5).tolist()
    assert np.allclose(vision.resize(np.array([[0.0, 1.0]]), 4, 1), [[0, 0.25, 0.75, 1]])
    ramp = np.tile(np.arange(32.0), (32, 1))
    d = vision.gradients(ramp)
    assert d.shape == (4, 128) and np.allclose(np.linalg.norm(d, axis=1), 1) and (d.reshape(-1, 8).max(0) > 0).sum() == 1
    assert len(vision.gradients(np.zeros((64, 64)))) == 0 and len(vision.gradients(np.ones((3, 3)))) == 0


def test_nearest_words_and_pairs(spark):
    rng = np.random.default_rng(5)
    x, book = rng.standard_normal((300, 6)), rng.standard_normal((40, 6))
    book[7] = book[3]
    assert vision.words_of(x, book).tolist() == ((x[:, None] - book) ** 2).sum(2).argmin(1).tolist()
    v = rng.standard_normal((90, 8))
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)] + [(100, [0.0] * 8), (101, None)], "id long, v array<double>")
    side, vision.SIDE = vision.SIDE, 20
    try:
        got = {(r.a, r.b): r.score for r in vision.all_pairs(rows, "id", "v", 0.3).collect()}
    finally:
        vision.SIDE = side
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j): s[i, j] for i in range(90) for j in range(i + 1, 90) if s[i, j] >= 0.3}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_blocks_of_pairs_are_few(spark, monkeypatch):
    """A vector is sent once for each block: with n vectors the blocks grow as n / SIDE, and a block is compared in strips."""
    monkeypatch.setattr(vision, "STRIP", 7)
    v = np.random.default_rng(6).standard_normal((3000, 4)).astype(np.float32)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, v array<float>")
    got = {(r.a, r.b): r.score for r in vision.all_pairs(rows, "id", "v", 0.999).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(s >= 0.999, 1)))}
    assert got.keys() == want and want and all(abs(got[k] - s[k]) < 1e-9 for k in got)


def test_idf_facts(spark, tmp_path):
    df = spark.createDataFrame([(1, "apple banana"), (2, "apple orange"), (3, "banana")], "id int, t string")
    index = text.TextIndex.build(df, "id", "t")
    got = {r.term: r.x for r in index.df.select("term", text.idf(3, F.col("df")).alias("x")).collect()}
    assert got == pytest.approx({"apple": np.log10(1.5), "banana": np.log10(1.5), "orange": np.log10(3)})
    stored = text.TextIndex.write(str(tmp_path / "i"), df, "id", "t")
    assert text.TextIndex.read(spark, str(tmp_path / "i"), "id").n == 3 and not stored.query("unknown")
    less = stored.without("banana")
    assert {r.term for r in less.df.collect()} == {"apple", "orange"} and less.top("banana", 3).count() == 0 and [r.id for r in less.top("apple banana", 3).collect()] == [1, 2]
    assert [r.id for r in stored.top("orange banana", 3).collect()] == [r.id for r in index.top("orange banana", 3).collect()] == [2, 3, 1]
    assert text.info("c", index, "p").first().documents == 3


@pytest.mark.parametrize("frequent", [0, 2, 1000])
def test_stored_weights_do_not_depend_on_what_is_broadcast(spark, tmp_path, monkeypatch, frequent):
    monkeypatch.setattr(text, "FREQUENT", frequent, raising=False)
    monkeypatch.setattr(text, "_RUN", 4, raising=False)
    rows = spark.createDataFrame([(1, "a b c a"), (2, "a b"), (3, "c d d e f g"), (4, None), (5, " 7 "), (None, "b h"), (6, "d e")], "id int, t string")
    stored, built = text.TextIndex.write(str(tmp_path / "i"), rows, "id", "t"), text.TextIndex.build(rows.where("id is not null"), "id", "t")
    assert stored.n == 7 and stored.df.where("term = 'b'").first().df == 3
    assert spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "i" / "bag")).count() == 7  # a row for each document
    some = text.TextIndex.write(str(tmp_path / "j"), rows.where("id is not null"), "id", "t")
    got, want = ({(r.id, r.term): (r.w, r.norm) for r in i.weighted.collect()} for i in (some, built))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    twice = spark.createDataFrame([(1, "a b"), (1, "a"), (2, "c")], "id int, t string")
    index = text.TextIndex.write(str(tmp_path / "k"), twice, "id", "t")
    assert sorted((r.id, r.term, round(r.w, 9)) for r in index.weighted.collect()) == sorted((i, t, round(float(np.log10(1 + tf) * np.log10(3)), 9)) for i, t, tf in ((1, "a", 2), (1, "b", 1), (2, "c", 1)))


def test_csv_and_images(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,name\n1,año\n2,\"x, y\"\n1,última\n".encode("latin-1"))
    rows = read_csv(spark, str(tmp_path / "a.csv"), {"id": SqlType("int"), "name": SqlType("varchar", 20)}, encoding="ISO-8859-1")
    assert sorted(map(tuple, rows.collect())) == [(1, "año"), (1, "última"), (2, "x, y")]
    last = last_of_each(rows.withColumn("at", F.monotonically_increasing_id()), "id", "at").select("id", "name")
    assert sorted(map(tuple, last.collect())) == [(1, "última"), (2, "x, y")]
    for n in ("a.jpg", "b.PNG", "c.txt"):
        (tmp_path / n).write_bytes(b"1 2 3 4")
    images = read_images(spark, str(tmp_path))
    assert sorted(r.name for r in images.collect()) == ["a.jpg", "b.PNG"]
    found = vision.describe(images, lambda raw: np.array(raw.split(), float).reshape(2, 2), "name").collect()
    assert found[0].descriptors == [[1.0, 2.0], [3.0, 4.0]]


def test_generated_rows(spark):
    a, b = random_rows(spark, 500), random_rows(spark, 500)
    assert a.count() == 500 and a.exceptAll(b).isEmpty()
    lo, hi = a.agg(F.min("timestamp"), F.max("timestamp")).first()
    assert (hi - lo).total_seconds() == 499 * 60
    assert a.where("price < 1 or price > 10000 or abs(latitude) > 90 or random_int < 1").isEmpty()


def test_plans_push_down(spark, tmp_path):
    rows = random_rows(spark, 20_000)
    path = str(tmp_path / "h")
    buckets = layouts.build(rows, "hash", ("random_int",), path, 20_000)
    plan = lambda df: df._jdf.queryExecution().toString()
    hit = spark.read.parquet(path).where((F.col(layouts.BUCKET) == layouts.bucket_of(F.lit(77), buckets)) & (F.col("random_int") == 77))
    assert "PartitionFilters: [isnotnull(_bucket" in plan(hit) and "EqualTo(random_int,77)" in plan(hit)
    layouts.build(rows, "bptree", ("price",), str(tmp_path / "b"), 20_000)
    ranged = spark.read.parquet(str(tmp_path / "b")).where("not (price > 30 or price < 10)").select("price")
    assert "LessThanOrEqual(price,30.0)" in plan(ranged) and "ReadSchema: struct<price:double>" in plan(ranged)
    near = spatial.closest(spark.read.parquet(str(tmp_path / "b")), ("latitude", "longitude"), (0, 0), 5, "random_int")
    assert "TakeOrderedAndProject" in plan(near)


def test_z_value_orders_cells(spark):
    df = spark.createDataFrame([(x, y) for x in range(4) for y in range(4)], "x int, y int")
    got = {(r.x, r.y): r.z for r in df.withColumn("z", spatial.z_value(("x", "y"), (0, 0), (4, 4), 2)).collect()}
    assert got == {(x, y): (x & 1) + 2 * (y & 1) + 4 * (x >> 1) + 8 * (y >> 1) for x in range(4) for y in range(4)}
