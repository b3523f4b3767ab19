"""Registered queries against their SQL on the smallest tables, and the pipeline end to end."""

import duckdb
import pytest

import corpus_pipeline
from labelq import llm
from tests.conftest import SF001

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = llm.QUERIES[name](spark, SF001)
    expected = con.sql(llm.ORACLE_SQL[name]).df()
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    got = df.select(*columns).toPandas()
    as_rows = lambda x: sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in x[columns].itertuples(index=False))
    assert as_rows(got) == as_rows(expected)


def test_pipeline(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "n-gram Jaccard join", "suffix-array dedup", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    out = corpus_pipeline.run(spark, SF001)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < out.select("doc_id").distinct().count() < docs.count()
    assert out.groupBy("doc_id").count().where("count > 2").count() == 0


@pytest.mark.parametrize(("name", "label"), [("op2_toxicity", "toxic"), ("op10_quality_knn", "quality")])
def test_held_out_accuracy(spark, name, label):
    sf = "/root/testdata/sf0.1"
    out = llm.QUERIES[name](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = {(r[label], r["predicted"]): r["count"] for r in out.groupBy(label, "predicted").count().collect()}
    rare, common = (1, 0) if label == "toxic" else (0, 1)
    assert n[rare, rare] >= 0.75 * (n[rare, rare] + n.get((rare, common), 0))
    assert n.get((common, rare), 0) <= 0.01 * n[common, common]


def test_pipeline_stages_on_empty_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF001)
        assert docs.count() == 0
