"""Queries with SQL against DuckDB, and the pipeline's stages on all that they are given."""

import random

import duckdb
import pytest

import corpus_pipeline
from sparkloom.llm import common, minhash, mixing, pii, queries
from sparkloom.llm.common import components


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(name, spark, sf_dir):
    df = queries.QUERIES[name](spark, sf_dir)
    connection = duckdb.connect()
    for t in ("pages", "embeddings"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = connection.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(map(repr, got.fetchall())) == sorted(repr(tuple(r[n] for n in names)) for r in df.collect())
    assert set(names) == set(df.columns)


def test_components(spark):
    edges = [(i + 1, i) for i in range(30)] + [(100, 50), (100, 60), (70, 60), (5, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 50 for i in (50, 60, 70, 100)}


def test_components_of_long_paths(spark, monkeypatch):
    """Paths of 2,000 ids settle in rounds of about their logarithm, whatever the order of the ids."""
    tables, write = [], common.written
    monkeypatch.setattr(common, "written", lambda df, tag, path=None: tables.append(tag) or write(df, tag, path))
    draw = random.Random(4)
    for ids in (draw.sample(range(1, 2001), 2000), [1, *range(2000, 1, -1)]):
        tables.clear()
        edges = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long")
        assert {r["id"]: r["component"] for r in components(edges).collect()} == dict.fromkeys(ids, 1)
        assert tables.count("labels") < 25


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frames, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = frames[name] = stage(spark, now, sf_dir).cache()
        if name != "encode":
            assert now.columns == docs.columns and now.dtypes == docs.dtypes
    ids = {name: {r["doc_id"] for r in df.select("doc_id").collect()} for name, df in frames.items()}
    assert ids["near_dedup"] <= ids["toxicity"] and ids["pii"] == ids["near_dedup"] and ids["mixing"] == ids["encode"]
    kept = {r["doc_id"] for r in minhash.near_duplicates(frames["toxicity"]).filter("kept").collect()}
    assert ids["near_dedup"] == kept
    assert all(not pii.base_spans(r["text"]) for r in frames["pii"].collect())
    taken = {r["doc_id"]: r["taken"] for r in mixing.shares(frames["pii"]).collect()}
    assert ids["mixing"] == {d for d, n in taken.items() if n}
    assert frames["mixing"].select(mixing.n_tokens(frames["mixing"]["text"]).alias("n")).groupBy().sum("n").first()[0] == sum(taken.values())


def test_pipeline_odd_rows(spark, sf_dir):
    """Stages on nulls, empty and very long texts, repeated rows and ids, and rows without an id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    odd = [(900, a), (901, a), (901, a), (902, b), (902, b), (902, a + " tail"), (903, None), (904, ""), (905, ""), (None, a), (None, b + " more"), (None, "only here " * 5), (None, "only here " * 5), (None, None), (906, "long text of words " * 60_000), (907, f"{a} mail x@y.org")]
    rows = spark.createDataFrame([(d, t, "en", None if d == 900 else "src0", len(t or "")) for d, t in odd], docs.schema)
    now = docs.unionAll(rows)
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        now = frames[name] = stage(spark, now, sf_dir).cache()
    ids = lambda df: [r["doc_id"] for r in df.filter("doc_id >= 900 or doc_id is null").collect()]
    assert sorted(ids(frames["toxicity"]), key=repr) == sorted((d for d, _ in odd), key=repr)
    kept = sorted(((r["doc_id"], r["text"]) for r in frames["near_dedup"].filter("doc_id >= 900 or doc_id is null").collect()), key=repr)
    assert kept == sorted([(900, a), (903, None), (904, ""), (905, ""), (None, "only here " * 5), (None, None), (906, odd[-2][1])], key=repr)
    assert frames["pii"].count() == frames["near_dedup"].count() and frames["pii"].filter("doc_id = 903 and text is null").count() == 1
    size = lambda df: df.select(mixing.n_tokens(df["text"]).alias("n")).groupBy().sum("n").first()[0]
    assert size(frames["mixing"]) == sum(r["taken"] for r in mixing.shares(frames["pii"]).collect())
    assert frames["encode"].count() == frames["mixing"].count()
    one = corpus_pipeline.STAGES[1][1](spark, spark.createDataFrame([(1, "p q", "x"), (1, "p q", "x")], "doc_id long, text string, _id string"), sf_dir).collect()
    assert [tuple(r) for r in one] == [(1, "p q", "x")]
    mail = corpus_pipeline.STAGES[2][1](spark, rows.filter("doc_id = 907"), sf_dir).first()
    assert mail["text"] == f"{a} mail <EMAIL>" and mail["n_chars"] == len(mail["text"])


def test_empty_tables(spark, sf_dir, tmp_path):
    for t in ("documents", "labels", "pages", "embeddings", "conversations"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, f in queries.QUERIES.items():
        got = f(spark, str(tmp_path))
        assert got.count() == (name == "op10_chat") and got.dtypes == f(spark, sf_dir).dtypes, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_and_clashing_columns(spark, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    wide = docs.withColumns({c: F.lit("x") for c in ("size", "score", "component", "target", "rep", "shingles", "_start", "_shard", "_copy", "_id", "predicted")})
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("text", F.lit("x")).write.parquet(f"{tmp_path}/labels.parquet")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumns({c: F.lit("x") for c in ("host", "key", "keys", "shard", "row", "bit", "held", "domain")})
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumns({c: F.lit("x") for c in ("query_id", "v", "rank", "score", "at")})
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("op3_urlfilter", "op6_topk"):
        assert sorted(map(repr, queries.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(map(repr, queries.QUERIES[name](spark, sf_dir).collect())), name
    for name in ("op1_pii", "op2_minhash", "op4_toxicity", "op5_pieces", "op7_licenses", "op8_mixing", "op9_fingerprint"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 40, name
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == wide.columns, name
    assert now.count() > 0
