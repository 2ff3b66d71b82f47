"""The registered queries and the pipeline on the smallest tables, against plain Python."""

import functools
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from quillspark.llm import ngram_join, packing, quality, secrets, sharding, token_ids, toxicity
from quillspark.llm.common import LOWER, span_hashes
from quillspark.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    folder = "/root/testdata/sf0.01"
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as from '{folder}/{t}.parquet'")
    df, want = QUERIES[name](spark, folder), con.sql(ORACLES[name])
    assert df.columns == want.columns
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(want.fetchall()) and got


@functools.lru_cache(maxsize=None)
def feature(raw: bytes, salt: int | None, bits: int = toxicity.BITS) -> int:
    a = LOWER[np.frombuffer(raw, np.uint8)]
    h = int(span_hashes(a, np.array([0]), np.array([len(a)]))[0])
    if salt is not None:
        from quillspark.llm.common import mix

        h = int(mix(np.array([(h + salt) % 2**64], np.uint64))[0])
    return h >> (64 - bits)


def naive_toxicity(text: str, theta: np.ndarray, bias: float) -> tuple[float, list[int]]:
    """Noisy-or and offending sentences, one sentence and word at a time."""
    theta, clean, bad = theta.astype(np.float32), 1.0, []
    said = [s for s in (re.findall(rb"[0-9A-Za-z\x80-\xff]+", part) for part in re.split(rb"[.!?\n]", (text or "").encode())) if s]
    for i, sentence in enumerate(said):
        names = {feature(w, None) for w in sentence} | {feature(w[:k], k) for w in sentence for k in toxicity.PREFIXES}
        p = 1 / (1 + np.exp(-np.clip(sum(float(theta[f]) for f in names) + bias, -30, 30)))
        clean *= 1 - min(p, 1 - 1e-12)
        if p >= 0.5:
            bad.append(i)
    return 1 - clean, bad


def test_op7(spark, docs):
    tables = [spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels")]
    model = toxicity.train(*tables)
    got = {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, DIR).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        p, bad = naive_toxicity(t, *model)
        assert abs(got[i].toxicity - p) < 1e-6 and got[i].toxic == int(p >= 0.5 and bool(bad))
        assert got[i].sentence_no == (bad if got[i].toxic else [])


def naive_statistics(text: str) -> list[float]:
    """The content statistics of quality.py, one character and word at a time."""
    raw = (text or "").encode()
    word = lambda b: b >= 128 or chr(b).isalnum()
    found = list(re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw))
    w = [m[0].lower() for m in found]
    sizes = [len(m[0]) for m in found]
    size, some, letters = max(len(raw), 1), max(len(w), 1), max(sum(map(word, raw)), 1)
    blank = [b == 32 or 9 <= b <= 13 for b in raw]
    symbol = [not word(b) and not s for b, s in zip(raw, blank)]
    mean = sum(sizes) / some
    return [
        sum(symbol) / size, sum(s and a == b for s, a, b in zip(symbol[1:], raw[1:], raw)) / size, sum(65 <= b <= 90 for b in raw) / letters, sum(48 <= b <= 57 for b in raw) / size, sum(blank) / size,
        mean, max(sum(x * x for x in sizes) / some - mean**2, 0) ** 0.5, sum(a == b for a, b in zip(w, w[1:])) / some, sum(a == b for a, b in zip(w, w[2:])) / some,
        len(set(w)) / some / max(1, np.log2(some + 1)), sum(chr(b) in "|<>{}" for b in raw) / size, raw.count(b"\n") / some, raw.count(b"!") / some, (raw.count(b".") + raw.count(b",")) / some,
    ]


def test_op1(spark, docs):
    tables = [spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels")]
    model = quality.train(*tables)
    got = {r.doc_id: r for r in QUERIES["op1_quality_classifier"](spark, DIR).collect()}
    assert sorted(got) == [i for i, _ in docs]
    about = {r.doc_id: (r.source, r.lang, r.n_chars) for r in tables[0].collect()}
    for i, t in docs:  # the same scores, one document at a time
        s = np.float32(naive_statistics(t)).astype(float)
        z = []
        for k, x in enumerate(([sum(e <= v for e in model["edges"][:, j]) + j * quality.BINS for j, v in enumerate(s)], quality._meta_code(*about[i]))):
            (a, b), w = model["calibration"][k], model["models"][k].w
            total = sum(w[c] for c in x) + w[-1]
            if k == 0:
                said = {feature(m[0], None, 12) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode())}
                total += quality.SHARE * sum(model["models"][0].words[c] for c in said) / max(1, len(said))
            z.append(a * np.clip(total, -30, 30) + b)
        p = 1 / (1 + np.exp(-np.clip(z[0] * model["combine"][0] + z[1] * model["combine"][1] + model["combine"][2], -30, 30)))
        assert abs(got[i].quality - p) < 1e-6 and got[i].keep == int(got[i].quality >= 0.5)
    right = [got[r.doc_id].keep == r.quality for r in tables[1].collect() if r.doc_id in got]
    assert np.mean(right) > 0.9


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [[*e.ids, 50256] for e in t.encode_batch(texts, add_special_tokens=False)]


def naive_pack(docs, groups, key, encode):
    """Sequences as (their documents, their tokens), by trying every open bin in turn."""
    out = []
    tokens = dict(zip((i for i, _ in docs), encode([t or "" for _, t in docs])))
    for g in range(groups):
        pieces = [(-len(ids[p : p + 2048]), i, p) for i, ids in tokens.items() if key[i] % groups == g for p in range(0, len(ids), 2048)]
        bins = []
        for size, i, p in sorted(pieces):
            home = next((b for b in bins if b[0] >= -size), None)
            if home is None:
                home = [2048, [], []]
                bins.append(home)
            home[0] += size
            home[1].append(i)
            home[2] += tokens[i][p : p + 2048]
        out += [tuple(b[1:]) for b in bins]
    return sorted(out)


def packed(rows):
    return sorted((r.doc_ids, r.tokens) for r in rows)


def test_op4(spark, docs, encode):
    assert packed(QUERIES["op4_packing"](spark, DIR).collect()) == naive_pack(docs, 1, {i: 0 for i, _ in docs}, encode)
    key = {r.doc_id: r.h % 2**64 for r in spark.read.parquet(f"{DIR}/documents.parquet").selectExpr("doc_id", "xxhash64(doc_id, 17) h").collect()}
    assert packed(packing.pack(spark.read.parquet(f"{DIR}/documents.parquet"), group_docs=50).collect()) == naive_pack(docs, 4, key, encode)


def test_op6(spark, docs):
    rows = QUERIES["op6_sharding"](spark, DIR).collect()
    assert sorted(r.doc_id for r in rows) == [i for i, _ in docs]
    load = np.bincount([r.shard for r in rows], minlength=64)
    assert load.max() <= -(-11 * len(docs) // 640) and all(r.moved == (r.shard != r.home_shard) for r in rows)
    owner = sharding.ring(64, 128)
    assert set(np.unique(owner)) == set(range(64))


def test_op8_and_op10(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    want = {i: e.ids for (i, _), e in zip(docs, t.encode_batch([x for _, x in docs], add_special_tokens=False))}
    ids = {r.doc_id: r for r in QUERIES["op10_bpe"](spark, DIR).collect()}
    assert {i: r.ids for i, r in ids.items()} == want and all(r.round_trip for r in ids.values())
    stored = QUERIES["op8_token_id_output"](spark, DIR)
    assert {r.doc_id: r.ids for r in token_ids.decode(stored).collect()} == want and stored.where("round_trip").count() == len(docs) + 1


def test_pipeline(spark, encode):
    """Each stage's decisions, made again one document at a time on what the stage before kept."""
    from test_joins import brute

    folder = "/root/testdata/sf0.01"  # the smallest tables have too few labels to learn toxicity from
    docs_df, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    docs = [(r.doc_id, r.text) for r in docs_df.orderBy("doc_id").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near copies", "secrets", "packing"]
    theta, bias = toxicity.train(docs_df, labels)
    now = [(i, t) for i, t in docs if (lambda p, bad: not (p >= 0.5 and bad))(*naive_toxicity(t, theta, bias))]
    assert 0 < len(now) < len(docs)
    kept = docs_df.where(docs_df.doc_id.isin([i for i, _ in now]))
    scores = {r.doc_id: r.keep for r in quality.score(kept, quality.train(kept, labels)).collect()}
    now = [(i, t) for i, t in now if scores[i]]
    first = {i for i, c, _ in brute(now, ngram_join.THRESHOLD) if i == c}
    now = [(i, t) for i, t in now if i in first]
    for name, pattern in secrets.RULES.items():
        now = [(i, re.sub(pattern, f"[{name}]", t, flags=re.ASCII)) for i, t in now]
    result = corpus_pipeline.run(spark, folder)
    assert packed(result.collect()) == naive_pack(now, 1, {i: 0 for i, _ in now}, encode)
    assert sorted(map(tuple, packing.unpack(result).collect())) == sorted(now)


def test_stages_keep_the_columns(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, DIR)
        assert out.columns == odd.columns, name
        out.collect()
        assert stage(spark, none, DIR).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, none, DIR).count() == 0


def test_ids_that_are_no_numbers_count_as_null(spark):
    from quillspark.llm import ann, vector_dedup

    docs = spark.createDataFrame([("x", "a text. with words", "high"), ("7", "other words here", "3"), (None, None, None)], "doc_id string, text string, n_chars string")
    labels = spark.createDataFrame([("7", "1", "no"), ("x", "good", "0"), ("8", None, None)], "doc_id string, quality string, toxic string")
    want = sorted([None, 7, None], key=repr)
    assert sorted((r.doc_id for r in quality.score(docs, quality.train(docs, labels)).collect()), key=repr) == want
    assert sorted((r.doc_id for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()), key=repr) == want
    assert quality.good(docs, {}).count() == toxicity.clean(docs, toxicity.train(docs, labels)).count() == 3
    assert [(r.doc_id, r.rule) for r in secrets.scan(docs, {"words": "words", "x": "with"}).orderBy("rule").collect()].count((7, "words")) == 1
    vectors = spark.createDataFrame([("x", [1.0, 0.0]), ("50", [1.0, 0.1]), ("3", [1.0, 0.0])], "vec_id string, embedding array<double>")
    assert sorted(map(tuple, vector_dedup.near_classes(vectors).collect())) == [(3, 3, 1), (50, 3, 1)]
    assert [tuple(r)[:3] for r in ann.neighbours(vectors).collect()] == [(50, 1, 3)]
