import pytest

from quillspark.errors import AlreadyExists, EngineError, Invalid, NotFound, SyntaxProblem
from quillspark.session import Engine

PLACES = [
    (1, "Lighthouse", 10.0, 20.0, "Porto", "red lamp by the sea"),
    (2, "Old mill", 10.5, 20.5, "Lyon", "mill wheel and river"),
    (3, "Castle", -3.0, 40.0, "Porto", "stone walls over the river"),
    (4, "Harbour", 10.0, 20.0, "Rome", "ships at sea, sea wind"),
    (5, "Bridge", 50.0, -4.0, "Lyon", "iron bridge"),
]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("db")
    e = Engine(spark, str(root / "tables"))
    path = root / "places.csv"
    path.write_text("id,name,lat,lon,city,about\n" + "".join(f'{a},{b},{c},{d},{x},"{y}"\n' for a, b, c, d, x, y in PLACES))
    e.sql("create table places (id int primary key, name varchar[12], lat double, lon double, city varchar[20] index hash, about text);")
    e.sql(f'COPY places FROM "{path}";')
    e.path = path
    return e


def ids(engine, where, rest=""):
    return [r[0] for r in engine.sql(f"select id from places where {where}{rest};").collect()]


def test_predicates(engine):
    assert sorted(ids(engine, 'city == "Porto"')) == [1, 3]
    assert sorted(ids(engine, 'city != "Porto"')) == [2, 4, 5]
    assert sorted(ids(engine, "lat > 10")) == [2, 5]
    assert sorted(ids(engine, "lat >= 10 and lon < 20.5")) == [1, 4, 5]
    assert sorted(ids(engine, 'name between "Bridge" and "Castle"')) == [3, 5]
    assert sorted(ids(engine, '(not (id > 4 or id < 2)) and id != 3')) == [2, 4]
    assert sorted(ids(engine, "id == 1 or id == 2 and id == 3")) == [1]
    assert ids(engine, "id == 9") == []
    assert sorted(ids(engine, 'lat == "10"')) == [1, 4]


def test_spatial(engine):
    assert sorted(ids(engine, "lat, lon == [10, 20]")) == [1, 4]
    assert sorted(ids(engine, "lat, lon between [0, 0] and [11, 21]")) == [1, 2, 4]
    assert ids(engine, "lat, lon in (10.4, 20.4) closest 2") == [2, 1]
    assert ids(engine, "lat, lon in (10, 20) radius 1") == [1, 4, 2]
    assert ids(engine, "lat, lon in (10, 20) radius 0.7072") == [1, 4, 2] and ids(engine, "lat, lon in (10, 20) radius 0.7071") == [1, 4]
    # the nearest are taken first, the other condition then filters them
    assert ids(engine, 'lat, lon in (10, 20) closest 2 and city == "Lyon"') == []
    # ranked rows come first, others by key
    assert ids(engine, 'city == "Lyon" or lat, lon in (10.4, 20.4) closest 2') == [2, 1, 5]


def test_radius_is_strict(engine):
    assert ids(engine, "lat, lon in (10, 17) radius 3") == []


def test_text(engine):
    assert ids(engine, 'about @@ "sea" top 5') == [4, 1]
    assert ids(engine, 'about @@ "SEA, river" top 2 and city == "Rome"') == [4]
    assert ids(engine, 'about @@ "unknown" top 5') == []


def test_project_and_limit(engine):
    assert engine.sql("select name, id, name from places where id == 3;").columns == ["name", "id", "name"]
    assert engine.sql("select * from places limit 2;").count() == 2
    assert ids(engine, "lat, lon in (10, 20) radius 1", " limit 1") == [1]


@pytest.mark.parametrize("kind,columns", [("bptree", "lat"), ("seq", "lat"), ("isam", "lat"), ("brin", "lat"), ("hash", "lat"), ("rtree", "lat, lon")])
def test_indexes_change_nothing(engine, kind, columns):
    asked = ["lat == 10", "lat between 0 and 10", "lat < 10.2", "lat, lon between [0, 0] and [11, 21]", "lat, lon in (10, 20) radius 1", "lat, lon == [10, 20]", "lat, lon in (10, 20) closest 3"]
    before = [sorted(ids(engine, w)) for w in asked]
    engine.sql(f"create index on places using {kind} ({columns});")
    with pytest.raises(AlreadyExists):
        engine.sql(f"create index on places using {kind} ({columns});")
    assert [sorted(ids(engine, w)) for w in asked] == before
    engine.sql('insert into places (id, name, lat, lon, city, about) values (6, "New", 10, 20, "Oslo", "new");')
    assert sorted(ids(engine, "lat == 10")) == [1, 4, 6]
    assert sorted(ids(engine, "lat, lon == [10, 20]")) == [1, 4, 6]
    engine.sql("delete from places where id == 6;")
    assert sorted(ids(engine, "lat == 10")) == [1, 4]
    engine.sql(f"drop index {kind} on values {columns} on places;")
    with pytest.raises(NotFound):
        engine.sql(f"drop index {kind} on values {columns} on places;")


def test_insert_delete_compact(engine, spark):
    engine.sql("create table t (id int primary key, at timestamp, ok bool, big ulong, s varchar[4]);")
    engine.sql('insert into t (id, ok, big, s) values (1, 0, 18446744073709551615, "añoño"); insert into t (s, big, ok, id) values ("x", 7, "true", 2);')
    a, b = engine.sql("select * from t;").orderBy("id").collect()
    assert (a.ok, int(a.big), a.s, b.ok, b.s) == (False, 2**64 - 1, "año", True, "x") and a.at is not None
    assert [r.id for r in engine.sql("select id from t where big > 9223372036854775807;").collect()] == [1]
    with pytest.raises(Invalid):
        engine.sql('insert into t (id, ok) values (1, 0);')
    with pytest.raises(Invalid):
        engine.sql('insert into t (id, ok, big, s) values ("one", 0, 1, "x");')
    engine.append("t", spark.range(10, 60).selectExpr("cast(id as int) id", "timestamp_ntz'2024-01-01' at", "true ok", "id big", "'r' s"))
    engine.sql("delete from t where id >= 20;")  # enough to compact
    t = engine.catalog.get("t")
    assert t.dead == 0 and t.snapshot == 1 and engine.table("t").count() == 12
    engine.sql("delete from t where s == \"r\" and id < 12;")
    assert sorted(r.id for r in engine.table("t").collect()) == [1, 2, *range(12, 20)]
    assert engine.catalog.get("t").dead == 2
    engine.sql("drop table t;")
    with pytest.raises(NotFound):
        engine.sql("select * from t;")


def test_text_index_follows_changes(engine):
    engine.sql("create table notes (id int primary key, body text);")
    assert engine.sql('select id from notes where body @@ "tiger" top 3;').collect() == []
    engine.sql('insert into notes (id, body) values (1, "tiger cat"); insert into notes (id, body) values (2, "dog cat");')
    assert [r.id for r in engine.sql('select id from notes where body @@ "tiger" top 3;').collect()] == [1]
    engine.sql('insert into notes (id, body) values (3, "tiger"); delete from notes where id == 1;')
    assert [r.id for r in engine.sql('select id from notes where body @@ "tiger" top 3;').collect()] == [3]


def test_text_index_reads_only_new_rows_as_text(engine, spark):
    e = engine
    e.sql('create table logs (id int primary key, body text);')
    e.append("logs", spark.createDataFrame([(1, "hold water run"), (2, "hold line water plant"), (3, "run fast hold tight")], "id int, body string"))
    top = lambda: [(r.id) for r in e.sql('select id from logs where body @@ "plant water" top 5;').collect()]
    assert top() == [2, 1]
    (first,) = [i for i in e.catalog.get("logs").indexes if i.kind == "spimi"]
    e.sql('insert into logs (id, body) values (4, "plant water grow strong"); delete from logs where id == 2;')
    assert top() == [4, 1]
    (index,) = [i for i in e.catalog.get("logs").indexes if i.kind == "spimi"]
    assert index.layout != first.layout and index.parts == 2 and e.indexes("logs").where("kind = 'spimi'").first().rows_behind == 0
    from quillspark.operators.text import TextIndex

    held = TextIndex.read(spark, index.layout, "_rid")
    built = TextIndex.build(e.storage.scan(e.catalog.get("logs")), "_rid", "body")
    rows = lambda i: sorted((r.term, r._rid, round(r.w, 12), round(r.norm, 12)) for r in i.weighted.collect())
    assert held.n == built.n == 3 and rows(held) == rows(built) and sorted(held.df.collect()) == sorted(built.df.collect())
    plan = held.scores("water hold")._jdf.queryExecution().toString()
    assert "In(term, [hold,water])" in plan.replace("WrappedArray", "") or "PushedFilters: [In(term" in plan
    assert plan.count("FileScan parquet") == 1  # the norms come with the postings
    assert e.dump("logs", "body").count() == held.df.count()


def test_text_ties_go_by_key(engine, spark):
    """Rows of equal score that were appended against the order of their keys."""
    engine.sql("create table twins (id int primary key, body text);")
    for ids_ in ((9, 7), (8, 3), (5, 2)):
        engine.append("twins", spark.createDataFrame([(i, "grey wolf") for i in ids_], "id int, body string").coalesce(1))
    engine.append("twins", spark.createDataFrame([(1, "blue sky"), (4, "grey sky blue")], "id int, body string"))
    ask = lambda k: [r.id for r in engine.sql(f'select id from twins where body @@ "wolf" top {k};').collect()]
    assert ask(3) == [2, 3, 5] and ask(9) == [2, 3, 5, 7, 8, 9]


def test_analyzers(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillspark.functions.analysis import stop_list
    from quillspark.operators.text import Analyzer

    (tmp_path / "stop.txt").write_text("the\nThis\n\n")
    own = Analyzer("english", tuple(stop_list(spark, str(tmp_path / "stop.txt"))), lambda c: F.when(c == "better", "good").otherwise(c))
    e = Engine(spark, str(tmp_path / "t"), analyzers={"own": own})
    e.sql('create table t (id int primary key, body text index spimi ("own")); insert into t (id, body) values (1, "the better run"); insert into t (id, body) values (2, "this"); insert into t (id, body) values (3, "other");')
    assert [r.id for r in e.sql('select id from t where body @@ "running better" top 5;').collect()] == [1]
    assert {r.term for r in e.dump("t", "body").collect()} == {"good", "better", "run", "other"}


def test_image_search(engine, spark):
    engine.sql("create table pics (id int primary key, f file);")
    engine.sql('insert into pics (id, f) values (1, "a"); insert into pics (id, f) values (2, "b"); insert into pics (id, f) values (3, "c");')
    d = spark.createDataFrame([("a", [[0.0], [0.1], [9.0]]), ("b", [[0.0], [9.1]]), ("c", [[5.0], [5.1]])], "n string, d array<array<double>>")
    with pytest.raises(Invalid):
        engine.sql('select id from pics where f <-> "a" top 1;')
    engine.register_descriptors("pics", "f", d, [[0.0], [5.0], [9.0]])
    assert [r.id for r in engine.sql('select id from pics where f <-> "a" top 1;').collect()] == [2]
    other = Engine(spark, engine.catalog.root)  # what was stored is there for another session
    assert [r.id for r in other.sql('select id from pics where f <-> "a" top 1;').collect()] == [2]
    other.add_descriptors("pics", "f", spark.createDataFrame([("d", [[5.0]])], "n string, d array<array<double>>"))
    assert {(r.name, r.word, r.n) for r in engine.image_words("pics", "f", "d").collect()} == {("d", 1, 1)}
    with pytest.raises(NotFound):
        engine.sql('select id from pics where f <-> "/no/such.pgm" top 1;')


def _stripes(kind, n=64):
    import numpy as np

    y, x = np.mgrid[:n, :n]
    grey = {"across": np.sin(y / 3), "down": np.sin(x / 3), "slanted": np.sin((x + y) / 4)}[kind]
    return b"P5\n# made here\n%d %d\n255\n" % (n, n) + ((grey + 1) * 127).astype(np.uint8).tobytes()


def test_search_by_image_files(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.sql("create table pics (id int primary key, f file);")
    for i, (kind, n) in enumerate([("across", 64), ("down", 64), ("slanted", 64), ("across", 96), ("down", 80)]):
        path = e.upload(f"{i}.pgm", _stripes(kind, n))
        e.sql(f'insert into pics (id, f) values ({i}, "{path}");')
    e.index_images("pics", "f", words=4)
    at = lambda i: e.catalog.root + f"/_files/{i}.pgm"
    assert [r.id for r in e.sql(f'select id from pics where f <-> "{at(0)}" top 1;').collect()] == [3]
    new = e.upload("new.pgm", _stripes("down", 128))  # an image that is not stored joins the others for the search
    assert {r.id for r in e.sql(f'select id from pics where f <-> "{new}" top 2;').collect()} == {1, 4}
    e.add_image("pics", "f", new)
    assert not e.image_words("pics", "f", new).isEmpty()
    with pytest.raises(Invalid):
        e.upload("../x", b"")


def test_copy_limit_and_errors(engine):
    engine.sql("create table few (id int primary key, name varchar[12], lat double, lon double, city varchar[20], about text);")
    engine.sql(f'copy few from "{engine.path}" limit 3;')
    assert engine.table("few").count() == 3
    for bad in ('copy few from "/no/such.csv";', "create table few (id int primary key);", "create table x (id int);", "select nothing from few;", "select * from few where nothing == 1;", "create table x (id int primary key, id int);"):
        with pytest.raises(EngineError):
            engine.sql(bad)
    assert engine.run("select id from few where id == 1;")["data"] == [[1]]
    assert engine.run("select id from none;")["status"] == 400
    wrong = engine.run("select id places;")
    assert wrong["status"] == 400 and wrong["expected"] == ["FROM"] and wrong["at"] == 10
    from quillspark.functions.types import BAD_VALUE

    (engine.path.parent / "bad.csv").write_text("id,name\n1,a\nx,b\n")
    engine.sql("create table strict (id int primary key, name varchar[5]);")
    with pytest.raises(Invalid, match=f"{BAD_VALUE}no int: x"):
        engine.sql(f'copy strict from "{engine.path.parent}/bad.csv";')
    assert engine.table("strict").count() == 0 and engine.run(f'copy strict from "{engine.path.parent}/bad.csv";')["status"] == 400
    assert Engine(engine.spark, engine.catalog.root).run("select id from places where id == 1;")["status"] == 200


def test_collection_of_texts(engine, tmp_path):
    (tmp_path / "songs.csv").write_bytes("id,body\n1,año\n2,b\n1,última\n".encode("latin-1"))
    engine.sql("create table songs (id int primary key, body text);")
    assert engine.load_collection("songs", str(tmp_path / "songs.csv")) == 2
    assert sorted(map(tuple, engine.table("songs").collect())) == [(1, "última"), (2, "b")]


def test_positions(engine):
    at = {r.id: r._rid for r in engine.positions("places").collect()}
    assert [r.id for r in engine.fetch("places", [at[3], at[5], 10**12]).orderBy("id").collect()] == [3, 5]


def test_two_writers(engine, spark):
    """Both start from the same description of the table; neither loses its rows or repeats an id."""
    engine.sql("create table shared (id int primary key);")
    other = Engine(spark, engine.catalog.root)
    a, b = engine.catalog.get("shared"), other.catalog.get("shared")
    engine.storage.append(a, spark.range(3).selectExpr("cast(id as int) id"))
    other.storage.append(b, spark.range(3, 7).selectExpr("cast(id as int) id"))
    assert sorted(r.id for r in engine.table("shared").collect()) == list(range(7))
    assert engine.positions("shared").select("_rid").distinct().count() == 7 and engine.catalog.get("shared").rows == 7
    assert not engine.catalog.files.write_new(f"{engine.catalog.folder('shared')}/_catalog/{engine.catalog._at('shared')[0]:012d}.json", "{}")
    with pytest.raises(AlreadyExists):
        other.catalog.create(b)


def test_small_parts_are_merged(engine, monkeypatch):
    from quillspark.sources import storage

    monkeypatch.setattr(storage, "MOST_PARTS", 3)
    engine.sql("create table bits (id int primary key);")
    for i in range(6):
        engine.sql(f"insert into bits (id) values ({i});")
    assert sorted(r.id for r in engine.table("bits").collect()) == list(range(6)) and len(engine.catalog.get("bits").parts) <= 3


def test_attached_tables(engine, spark):
    e = Engine(spark, engine.catalog.root)
    e.attach("nums", spark.range(50).selectExpr("id", "id % 7 as m", "cast(id as string) s"), "id")
    assert [r.id for r in e.sql("select id from nums where m == 3 and id < 20;").collect()] == [3, 10, 17]
    plan = e.sql("select m from nums where m == 3;")._jdf.queryExecution().toString()
    assert "monotonically" not in plan
    e.sql("create index on nums using hash (m) params (4);")
    assert sorted(r.id for r in e.sql("select id from nums where m == 3;").collect()) == list(range(3, 50, 7))
    assert e.dump("nums", "m").agg({"n": "sum"}).first()[0] == 50
    for change in ("insert into nums (id, m, s) values (1, 1, \"x\");", "delete from nums where id == 1;"):
        with pytest.raises(Invalid):
            e.sql(change)
    e.sql("drop table nums;")
    assert not e.catalog.exists("nums")


def test_info(engine):
    rows = {(r.table, r.column): r for r in engine.info().collect()}
    assert rows["places", "id"].primary_key and rows["places", "city"]["index"] == "hash" and rows["places", "about"]["index"] == "spimi"


def test_index_state(engine):
    engine.sql("create table k (id int primary key);")
    engine.sql("insert into k (id) values (1);")
    (r,) = engine.indexes("k").collect()
    assert (r.kind, r["columns"], r.built, r.rows_behind) == ("bptree", "id", False, 1)
    engine.compact("k")
    (r,) = engine.indexes("k").collect()
    assert r.built and r.files > 0 and r.rows_behind == 0


@pytest.mark.parametrize("bad", ["select * from t", "select from t;", "update t;", "select * from t where a, b in (1) closest 2;", "select * from t where a = 1;", "select * from t where a, b > [1, 2];", "create index btree on t;", "delete from t;", ";", "select * from t where a == 'x';"])
def test_syntax_errors(bad):
    from quillspark.plans.parser import parse

    with pytest.raises(SyntaxProblem):
        parse(bad)


def test_stream(engine, spark, tmp_path):
    from quillspark.streaming.ingest import append_stream, csv_stream

    engine.sql("create table log (id int primary key, v double);")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,v\n1,2.5\n2,3.5\n")
    for _ in range(2):
        append_stream(engine, "log", csv_stream(engine, "log", str(tmp_path / "in")), str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(tuple, engine.table("log").collect())) == [(1, 2.5), (2, 3.5)]


def test_a_batch_that_comes_again_changes_nothing(engine, spark):
    """As after a stop between the append and the stream's own mark."""
    engine.sql("create table once (id int primary key);")
    rows = spark.range(4).selectExpr("cast(id as int) id")
    for number in (0, 0, 1, 1, 0):
        engine.append("once", rows, ("stream", number))
    engine.append("once", rows, ("another", 0))
    assert engine.table("once").count() == 12 and engine.catalog.get("once").batches == (("another", 0), ("stream", 1))
