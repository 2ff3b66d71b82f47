"""The registered queries over the reference's own operators and the SQL that checks them.

All of them run over their whole tables; limits are only where a top k is the feature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.analysis import bag_of_words
from .operators import layouts, spatial, text, vision
from .session import Engine
from .sources.checkpoints import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(sql: str | None = None):  # noqa: ANN201
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def engine(spark: SparkSession, sf_dir: str, **keys: str) -> Engine:
    """A new engine with some of the given tables attached under their names; the value names the key column."""
    e = Engine(spark, shared_folder(spark, "tables"))
    for table, key in keys.items():
        e.attach(table, read(spark, sf_dir, table), key)
    return e


def _dialect(name: str, table: str, key: str, statement: str, sql: str) -> None:
    QUERIES[name] = lambda spark, d: engine(spark, d, **{table: key}).sql(statement)
    ORACLES[name] = sql


for _name, _table, _key, _columns, _where, _sql in [
    ("scan_all", "nation", "n_nationkey", "*", "", ""),
    ("project_cols", "customer", "c_custkey", "c_name, c_custkey", "", ""),
    ("filter_eq_int", "part", "p_partkey", "*", "p_size == 11", "p_size = 11"),
    ("filter_eq_str", "customer", "c_custkey", "c_custkey, c_mktsegment", 'c_mktsegment == "BUILDING"', "c_mktsegment = 'BUILDING'"),
    ("filter_eq_double", "lineitem", "l_orderkey", "l_orderkey, l_linenumber, l_discount", "l_discount == 0.05", "l_discount = 0.05"),
    ("filter_ne", "orders", "o_orderkey", "o_orderkey, o_orderstatus", 'o_orderstatus != "F"', "o_orderstatus <> 'F'"),
    ("filter_lt", "part", "p_partkey", "p_partkey, p_retailprice", "p_retailprice < 910.5", "p_retailprice < 910.5"),
    ("filter_lt_str", "customer", "c_custkey", "c_custkey, c_name", 'c_name < "Customer#000000500"', "c_name < 'Customer#000000500'"),
    ("filter_le", "lineitem", "l_orderkey", "l_orderkey, l_linenumber, l_quantity", "l_quantity <= 10", "l_quantity <= 10"),
    ("filter_gt", "customer", "c_custkey", "c_custkey, c_acctbal", "c_acctbal > 5000", "c_acctbal > 5000"),
    ("filter_ge", "events", "event_id", "event_id, user_id, value", "value >= 50", "value >= 50"),
    ("filter_between_num", "lineitem", "l_orderkey", "l_orderkey, l_linenumber, l_quantity", "l_quantity between 5 and 7", "l_quantity BETWEEN 5 AND 7"),
    ("filter_between_str", "nation", "n_nationkey", "n_nationkey, n_name", 'n_name between "NATION_10" and "NATION_15"', "n_name BETWEEN 'NATION_10' AND 'NATION_15'"),
    ("filter_between_ts", "events", "event_id", "event_id, ts", 'ts between "2024-01-03 00:00:00" and "2024-01-20 00:00:00"', "ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20'"),
    ("bool_and", "part", "p_partkey", "p_partkey, p_size", "p_size > 10 and p_size < 20", "p_size > 10 AND p_size < 20"),
    ("bool_or", "part", "p_partkey", "p_partkey, p_size", "p_size < 3 or p_size > 48", "p_size < 3 OR p_size > 48"),
    ("bool_not", "part", "p_partkey", "p_partkey, p_size", "not p_size between 10 and 40", "NOT p_size BETWEEN 10 AND 40"),
    ("bool_nested", "part", "p_partkey", "p_partkey, p_size", "(not (p_size > 30 or p_size < 10)) and p_size != 25", "(NOT (p_size > 30 OR p_size < 10)) AND p_size <> 25"),
    ("bool_precedence", "part", "p_partkey", "p_partkey, p_size", "p_size == 1 or p_size == 2 and p_retailprice > 915", "p_size = 1 OR (p_size = 2 AND p_retailprice > 915)"),
    ("point_exact", "part", "p_partkey", "p_partkey, p_size, p_retailprice", "p_partkey, p_retailprice == [36, 903.6]", "abs(p_partkey - 36) <= 1e-6 AND abs(p_retailprice - 903.6) <= 1e-6"),
    ("box_2d", "part", "p_partkey", "p_partkey, p_size, p_retailprice", "p_size, p_retailprice between [10, 903] and [20, 915]", "p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 903 AND 915"),
    ("box_3d", "part", "p_partkey", "p_partkey, p_size", "p_size, p_retailprice, p_partkey between [10, 905, 100] and [30, 950, 900]", "p_size BETWEEN 10 AND 30 AND p_retailprice BETWEEN 905 AND 950 AND p_partkey BETWEEN 100 AND 900"),
]:
    _dialect(_name, _table, _key, f"select {_columns} from {_table}{' where ' + _where if _where else ''};", f"SELECT {_columns} FROM {_table}{' WHERE ' + _sql if _sql else ''}")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def limit_sorted(spark: SparkSession, d: str) -> DataFrame:
    e = Engine(spark, shared_folder(spark, "tables"))
    e.attach("orders", read(spark, d, "orders").orderBy("o_orderkey"), "o_orderkey")
    return e.sql("select o_orderkey, o_totalprice from orders limit 25;")


_DIST = "sqrt(CAST((p_size - 25.0) * (p_size - 25.0) AS DOUBLE) + (p_retailprice - 910.0) * (p_retailprice - 910.0))"


@query(f"SELECT p_partkey, round({_DIST}, 6) AS dist FROM part ORDER BY {_DIST}, p_partkey LIMIT 20")
def knn_2d(spark: SparkSession, d: str) -> DataFrame:
    return spatial.closest(read(spark, d, "part"), ("p_size", "p_retailprice"), (25, 910), 20, "p_partkey").select("p_partkey", F.round(spatial.DIST, 6).alias("dist"))


@query(f"SELECT p_partkey FROM (SELECT * FROM part ORDER BY {_DIST}, p_partkey LIMIT 50) WHERE p_size > 25")
def knn_postfilter(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d, part="p_partkey").sql("select p_partkey from part where p_size, p_retailprice in (25, 910) closest 50 and p_size > 25;")


def placed(df: DataFrame) -> DataFrame:
    """The rows with their place in the order in which a ranking returns them."""
    return layouts.numbered(df, "place").withColumn("place", F.col("place").cast("int"))


@query(f"SELECT row_number() OVER (ORDER BY {_DIST}, p_partkey)::INT AS place, p_partkey FROM part WHERE {_DIST} < 8 AND p_size <> 25")
def radius_ordered(spark: SparkSession, d: str) -> DataFrame:
    return placed(engine(spark, d, part="p_partkey").sql("select p_partkey from part where p_size, p_retailprice in (25, 910) radius 8 and p_size != 25;"))


@query(f"WITH c AS (SELECT p_partkey, {_DIST} AS dist FROM part ORDER BY {_DIST}, p_partkey LIMIT 12) SELECT row_number() OVER (ORDER BY c.dist NULLS LAST, part.p_partkey)::INT AS place, part.p_partkey FROM part LEFT JOIN c USING (p_partkey) WHERE c.dist IS NOT NULL OR p_size = 1")
def knn_or_filter(spark: SparkSession, d: str) -> DataFrame:
    return placed(engine(spark, d, part="p_partkey").sql("select p_partkey from part where p_size, p_retailprice in (25, 910) closest 12 or p_size == 1;"))


@query(f"SELECT p_partkey, round({_DIST}, 6) AS dist FROM part WHERE {_DIST} < 8")
def radius_2d(spark: SparkSession, d: str) -> DataFrame:
    near = spatial.radius(read(spark, d, "part"), ("p_size", "p_retailprice"), (25, 910), 8)
    return near.select("p_partkey", F.round(spatial.DIST, 6).alias("dist"))


def _indexed(name: str, table: str, key: str, kind: str, columns: str, where: str, sql: str, params: str = "") -> None:
    """An index is created over the table, and the condition answered through it."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return engine(spark, d, **{table: key}).sql(f"create index on {table} using {kind} ({columns}){params}; select * from {table} where {where};")

    QUERIES[name] = run
    ORACLES[name] = f"SELECT * FROM {table} WHERE {sql}"


_indexed("hash_lookup", "orders", "o_orderkey", "hash", "o_custkey", "o_custkey == 77", "o_custkey = 77")
_indexed("hash_params", "customer", "c_custkey", "hash", "c_nationkey", "c_nationkey == 7", "c_nationkey = 7", " params (16)")
_indexed("bptree_range", "orders", "o_orderkey", "bptree", "o_totalprice", "o_totalprice between 1000 and 50000", "o_totalprice BETWEEN 1000 AND 50000")
_indexed("seq_range", "customer", "c_custkey", "seq", "c_acctbal", "c_acctbal between 0 and 1000", "c_acctbal BETWEEN 0 AND 1000")
_indexed("isam_range", "customer", "c_custkey", "isam", "c_nationkey", "c_nationkey between 3 and 5", "c_nationkey BETWEEN 3 AND 5")
_indexed("brin_range", "events", "event_id", "brin", "ts", 'ts between "2024-01-03 00:00:00" and "2024-01-05 00:00:00"', "ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-05'")
_indexed("rtree_box", "part", "p_partkey", "rtree", "p_size, p_retailprice", "p_size, p_retailprice between [5, 902] and [15, 918]", "p_size BETWEEN 5 AND 15 AND p_retailprice BETWEEN 902 AND 918")
_indexed("rtree_radius", "part", "p_partkey", "rtree", "p_size, p_retailprice", "p_size, p_retailprice in (25, 910) radius 8", f"{_DIST} < 8")


@query("SELECT 'hash' AS kind, 'o_custkey' AS columns, true AS built, 0::BIGINT AS rows_behind")
def index_state(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d, orders="o_orderkey")
    e.sql("create index on orders using hash (o_custkey); create index on orders using bptree (o_orderkey); drop index bptree on values o_orderkey on orders;")
    return e.indexes("orders").where("built").select("kind", "columns", "built", "rows_behind")


@query("SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")
def index_dump(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d, orders="o_orderkey")
    e.sql("create index on orders using isam (o_totalprice);")
    return e.dump("orders", "o_totalprice").agg(F.sum("n").alias("n"), F.min("lo_o_totalprice").alias("lo"), F.max("hi_o_totalprice").alias("hi"))


@query("SELECT * FROM orders WHERE o_orderkey IN (3, 7, 33, 1000)")
def fetch_positions(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d, orders="o_orderkey").fetch("orders", [3, 7, 33, 1000]).drop("_rid")


@query("SELECT event_id // 1200 AS block, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY 1")
def brin_zone_map(spark: SparkSession, d: str) -> DataFrame:
    return layouts.zone_map(read(spark, d, "events"), "ts", "event_id")


@query("SELECT event_id, value FROM events WHERE value BETWEEN 10 AND 12")
def brin_pruned_range(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events")
    return layouts.through_zone_map(rows, layouts.zone_map(rows, "value", "event_id"), "value", "event_id", 10, 12).select("event_id", "value")


@query("SELECT concat(floor(p_size / 10.0)::BIGINT, '_', floor(p_retailprice / 20.0)::BIGINT) AS cell, count(*) AS n, min(p_size) AS min_p_size, max(p_size) AS max_p_size, min(p_retailprice) AS min_p_retailprice, max(p_retailprice) AS max_p_retailprice FROM part GROUP BY 1")
def rtree_mbr(spark: SparkSession, d: str) -> DataFrame:
    return spatial.bounds(read(spark, d, "part"), ("p_size", "p_retailprice"), (10, 20))


@query("SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS position FROM customer")
def isam_sorted(spark: SparkSession, d: str) -> DataFrame:
    return layouts.in_order(read(spark, d, "customer"), ["c_acctbal"], "c_custkey").select("c_custkey", "c_name", "position")


_PART = "p_partkey long primary key, p_name varchar[55], p_brand varchar[10], p_type varchar[25], p_size int, p_retailprice double"


def _part_table(spark: SparkSession, d: str) -> Engine:
    """A new engine with the table part, copied from CSV."""
    e = Engine(spark, shared_folder(spark, "tables"))
    csv = shared_folder(spark, "csv")
    read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice").write.option("header", True).csv(csv)
    e.sql(f'create table part ({_PART}); copy part from "{csv}";')
    return e


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def csv_copy_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _part_table(spark, d).table("part")


@query("SELECT p_partkey, p_name, p_size FROM part UNION ALL SELECT 9000001, 'new part', 7")
def insert_select(spark: SparkSession, d: str) -> DataFrame:
    return _part_table(spark, d).sql('insert into part (p_partkey, p_name, p_brand, p_type, p_size, p_retailprice) values (9000001, "new part", "B", "T", 7, 1.5); select p_partkey, p_name, p_size from part;')


@query("SELECT p_partkey, p_size FROM part WHERE NOT (p_partkey < 20)")
def delete_select(spark: SparkSession, d: str) -> DataFrame:
    return _part_table(spark, d).sql("delete from part where p_partkey < 20; select p_partkey, p_size from part;")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_partkey <> 40 UNION ALL SELECT 9000001, 15")
def stored_index_select(spark: SparkSession, d: str) -> DataFrame:
    """Rows that came and went after the index was built are seen through it."""
    return _part_table(spark, d).sql(
        'create index on part using isam (p_size); insert into part (p_partkey, p_name, p_brand, p_type, p_size, p_retailprice) values (9000001, "new part", "B", "T", 15, 1.5);'
        "delete from part where p_partkey == 40; select p_partkey, p_size from part where p_size between 10 and 20;"
    )


@query("SELECT * FROM (VALUES ('dropped')) t(state)")
def drop_table(spark: SparkSession, d: str) -> DataFrame:
    e = _part_table(spark, d)
    e.sql("drop table part;")
    return spark.createDataFrame([("there" if e.catalog.exists("part") else "dropped",)], "state string")


@query("SELECT p_partkey, p_size FROM part WHERE p_size <= 25")
def compact_select(spark: SparkSession, d: str) -> DataFrame:
    return _part_table(spark, d).sql("delete from part where p_size > 25; select p_partkey, p_size from part;")


@query("SELECT * FROM (VALUES ('part', 'p_partkey', 'long', true, 'bptree'), ('part', 'p_name', 'varchar[55]', false, NULL), ('part', 'p_brand', 'varchar[10]', false, NULL), ('part', 'p_type', 'varchar[25]', false, NULL), ('part', 'p_size', 'int', false, NULL), ('part', 'p_retailprice', 'double', false, NULL)) t(\"table\", \"column\", type, primary_key, index)")
def catalog_info(spark: SparkSession, d: str) -> DataFrame:
    return _part_table(spark, d).info()


# -- text

_BAG = "WITH tok AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS term FROM documents), bag AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term <> '' GROUP BY 1, 2)"
_WEIGHTS = f"{_BAG}, df AS (SELECT term, count(*) AS df FROM bag GROUP BY 1), n AS (SELECT count(*) AS n FROM documents), w AS (SELECT doc_id, term, log10(1 + tf) * log10(n / df) AS w FROM bag JOIN df USING (term), n)"
_ASK = "nicht thenand oneaer que"
_QUERY = f"{_WEIGHTS}, q AS (SELECT term, log10(1 + count(*)) AS t FROM (SELECT unnest(string_split('{_ASK}', ' ')) AS term) GROUP BY 1), qw AS (SELECT term, t * log10(n / df) AS q FROM q JOIN df USING (term), n), s AS (SELECT doc_id, sum(w * q) / ((SELECT sqrt(sum(w2.w * w2.w)) FROM w w2 WHERE w2.doc_id = w.doc_id) * (SELECT sqrt(sum(q * q)) FROM qw)) AS score FROM w JOIN qw USING (term) GROUP BY doc_id)"


def _bag(spark: SparkSession, d: str) -> DataFrame:
    return bag_of_words(read(spark, d, "documents"), "doc_id", "text", unique=True)


def _index(spark: SparkSession, d: str) -> text.TextIndex:
    """Built, stored and read again."""
    return text.TextIndex.write(shared_folder(spark, "text"), read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query(f"{_BAG} SELECT doc_id, term, tf FROM bag")
def text_bow(spark: SparkSession, d: str) -> DataFrame:
    return _bag(spark, d)


@query(f"{_BAG} SELECT term, count(*) AS df FROM bag GROUP BY 1")
def text_df(spark: SparkSession, d: str) -> DataFrame:
    return text.document_frequency(_bag(spark, d))


@query(f"{_BAG} SELECT term, round(log10((SELECT count(*) FROM documents) / count(*)), 9) AS idf FROM bag GROUP BY 1")
def text_idf(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "documents").count()
    return text.document_frequency(_bag(spark, d)).select("term", F.round(text.idf(n, F.col("df")), 9).alias("idf"))


@query(f"{_BAG} SELECT doc_id FROM bag WHERE term = 'nicht'")
def text_postings(spark: SparkSession, d: str) -> DataFrame:
    return text.postings(_bag(spark, d), "nicht", "doc_id")


@query(f"{_WEIGHTS} SELECT doc_id, term, round(w, 9) AS w FROM w")
def text_weights(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).weighted.select("doc_id", "term", F.round("w", 9).alias("w"))


@query(f"{_WEIGHTS} SELECT doc_id, round(sqrt(sum(w * w)), 6) AS norm FROM w GROUP BY 1")
def text_norms(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).norm.select("doc_id", F.round("norm", 6).alias("norm"))


@query(f"{_QUERY} SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY round(s.score, 12) DESC, doc_id LIMIT 10")
def text_topk(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).top(_ASK, 10).select("doc_id", F.round("score", 6).alias("score"))


_BEST = f"{_QUERY}, b AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 12) DESC, doc_id)::INT AS place FROM s WHERE score > 0 QUALIFY place <= <K>)"


@query(f"{_BEST.replace('<K>', '10')} SELECT place, doc_id FROM b")
def text_match(spark: SparkSession, d: str) -> DataFrame:
    return placed(engine(spark, d, documents="doc_id").sql(f'select doc_id from documents where text @@ "{_ASK}" top 10;'))


@query(f"{_BEST.replace('<K>', '40')} SELECT doc_id, lang FROM b JOIN documents USING (doc_id) WHERE lang = 'de' ORDER BY place LIMIT 5")
def text_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d, documents="doc_id").sql(f'select doc_id, lang from documents where text @@ "{_ASK}" top 40 and lang == "de" limit 5;')


@query(f"{_BEST.replace('<K>', '10')} SELECT place, doc_id FROM b".replace("FROM documents)", "FROM (SELECT * FROM documents WHERE doc_id % 9 <> 4))").replace("FROM documents),", "FROM (SELECT * FROM documents WHERE doc_id % 9 <> 4)),"))
def text_match_after_changes(spark: SparkSession, d: str) -> DataFrame:
    """The stored index follows rows that are appended and deleted; only new ones are read as text."""
    e = Engine(spark, shared_folder(spark, "tables"))
    docs = read(spark, d, "documents").select("doc_id", "text")
    ask = f'select doc_id from docs where text @@ "{_ASK}" top 10;'
    e.sql("create table docs (doc_id long primary key, text text, part int);")
    e.append("docs", docs.where("doc_id % 9 > 1").withColumn("part", F.expr("int(doc_id % 9)")))
    e.sql(ask)
    e.append("docs", docs.where("doc_id % 9 <= 1").withColumn("part", F.expr("int(doc_id % 9)")))
    return placed(e.sql(f"delete from docs where part == 4; {ask}"))


@query(f"{_BAG} SELECT count(*) AS documents, (SELECT count(DISTINCT term) FROM bag) AS terms FROM documents")
def text_collection(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    return text.info("documents", index, "").select("documents", F.lit(index.df.count()).alias("terms"))


@query(f"{_BAG} SELECT term, count(*) AS df FROM bag WHERE term <> 'the' GROUP BY 1")
def text_remove_term(spark: SparkSession, d: str) -> DataFrame:
    return text.document_frequency(text.without_term(_bag(spark, d), "the"))


@query()
def text_bow_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return bag_of_words(read(spark, d, "documents"), "doc_id", "text", "english", unique=None)


# -- vectors and visual words

_COS = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"


@query(f"SELECT e.vec_id, round({_COS.format(a='e.embedding', b='q.embedding')}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.vec_id <> 7 ORDER BY {_COS.format(a='e.embedding', b='q.embedding')} DESC, e.vec_id LIMIT 15")
def vec_cosine_knn(spark: SparkSession, d: str) -> DataFrame:
    return vision.nearest_vectors(read(spark, d, "embeddings"), "vec_id", "embedding", 7, 15).select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT x.vec_id AS a, y.vec_id AS b, round({_COS.format(a='x.embedding', b='y.embedding')}, 6) AS score FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE {_COS.format(a='x.embedding', b='y.embedding')} >= 0.4")
def vec_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    return vision.all_pairs(read(spark, d, "embeddings"), "vec_id", "embedding", 0.4).select("a", "b", F.round("score", 6).alias("score"))


_WORDS = 16
_HIST = f"""WITH parts AS (SELECT vec_id, unnest(range(8)) AS j, embedding FROM embeddings),
desc_ AS (SELECT vec_id, j, list_transform(embedding[j * 8 + 1 : j * 8 + 8], lambda x: x::DOUBLE) AS d FROM parts),
book AS (SELECT row_number() OVER (ORDER BY vec_id, j) - 1 AS word, d AS c FROM desc_ QUALIFY word < {_WORDS}),
near AS (SELECT vec_id, j, word, row_number() OVER (PARTITION BY vec_id, j ORDER BY list_sum(list_transform(range(1, 9), lambda i: (d[i] - c[i]) * (d[i] - c[i]))), word) AS r FROM desc_, book),
hist AS (SELECT vec_id, word::INTEGER AS word, count(*) AS n FROM near WHERE r = 1 GROUP BY 1, 2)"""
_VISUAL = f"""{_HIST}, idf AS (SELECT word, ln(((SELECT count(DISTINCT vec_id) FROM hist) + 1) / (count(*) + 1)) + 1 AS idf FROM hist GROUP BY 1),
raw AS (SELECT vec_id, word, n * idf AS raw FROM hist JOIN idf USING (word)),
w AS (SELECT vec_id, word, raw / (sqrt(sum(raw * raw) OVER (PARTITION BY vec_id)) + 1e-10) AS w FROM raw)"""


def _first_words(parts: DataFrame) -> list[list[float]]:
    """A codebook that SQL can write down as well: the first descriptors by id. ``kmeans_vocab`` has one that is fitted to all."""
    first = parts.orderBy("vec_id").limit(_WORDS // 8).collect()
    return [list(v) for r in first for v in r["descriptors"]]


def _visual_histogram(spark: SparkSession, d: str) -> DataFrame:
    parts = vision.cut_descriptors(read(spark, d, "embeddings"), "vec_id", "embedding", 8)
    return vision.histogram(parts, _first_words(parts), "vec_id")


@query(f"{_HIST} SELECT vec_id, word, n FROM hist")
def bovw_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _visual_histogram(spark, d)


@query(f"{_VISUAL} SELECT vec_id, word, round(w, 9) AS w FROM w")
def bovw_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return vision.tf_idf(_visual_histogram(spark, d), "vec_id").select("vec_id", "word", F.round("w", 9).alias("w"))


@query(f"{_VISUAL}, s AS (SELECT a.vec_id, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.word = b.word AND b.vec_id = 7 WHERE a.vec_id <> 7 GROUP BY 1), z AS (SELECT vec_id, sqrt(sum(w * w)) AS size FROM w GROUP BY 1) SELECT s.vec_id, round(dot / (z.size * (SELECT size FROM z WHERE vec_id = 7)), 6) AS score FROM s JOIN z USING (vec_id) ORDER BY round(dot / (z.size * (SELECT size FROM z WHERE vec_id = 7)), 12) DESC, s.vec_id LIMIT 10")
def bovw_knn(spark: SparkSession, d: str) -> DataFrame:
    return vision.nearest(vision.tf_idf(_visual_histogram(spark, d), "vec_id"), "vec_id", 7, 10).select("vec_id", F.round("score", 6).alias("score"))


@query(f"{_VISUAL}, s AS (SELECT a.vec_id, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.word = b.word AND b.vec_id = 7 WHERE a.vec_id <> 7 GROUP BY 1), z AS (SELECT vec_id, sqrt(sum(w * w)) AS size FROM w GROUP BY 1), k AS (SELECT s.vec_id, row_number() OVER (ORDER BY round(dot / (z.size * (SELECT size FROM z WHERE vec_id = 7)), 12) DESC, s.vec_id::VARCHAR COLLATE C)::INT AS r FROM s JOIN z USING (vec_id)) SELECT vec_id FROM k WHERE r <= 10")
def image_match(spark: SparkSession, d: str) -> DataFrame:
    """Vectors stand for image files: their descriptors are stored with the table and searched through the dialect."""
    e, rows = Engine(spark, shared_folder(spark, "tables")), read(spark, d, "embeddings")
    e.sql("create table pictures (vec_id long primary key, picture file);")
    e.append("pictures", rows.select("vec_id", F.col("vec_id").cast("string").alias("picture")))
    parts = vision.cut_descriptors(rows, "vec_id", "embedding", 8)
    e.register_descriptors("pictures", "picture", parts, _first_words(parts))
    return e.sql('select vec_id from pictures where picture <-> "7" top 10;')


@query()
def kmeans_vocab(spark: SparkSession, d: str) -> DataFrame:
    parts = vision.cut_descriptors(read(spark, d, "embeddings"), "vec_id", "embedding", 8)
    book = vision.vocabulary(parts, 32)
    return spark.createDataFrame([(i, c) for i, c in enumerate(book)], "word int, centre array<double>")


@query()
def pca_reduce(spark: SparkSession, d: str) -> DataFrame:
    return vision.reduce_dimensions(read(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 8)
