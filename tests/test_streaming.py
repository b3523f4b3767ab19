"""Stateless operators on a streaming source; exactly-once file sink."""

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelq.session import materialize
from labelq.streaming.scoring_stream import parse_responses, start_scoring_stream
from tests.conftest import SF001


def lengths(texts):
    return [{"n": len(t or "")} for t in texts]


def test_scoring_stream_over_documents(spark, tmp_out):
    schema = spark.read.parquet(f"{SF001}/documents.parquet").schema
    q = start_scoring_stream(
        spark, SF001, schema, "text", ["doc_id"], lengths, [T.StructField("n", T.LongType())],
        os.path.join(tmp_out, "out"), os.path.join(tmp_out, "ckpt"), glob="documents.parquet",
    )
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(tmp_out, "out"))
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    assert out.count() == docs.count()
    bad = out.join(docs, "doc_id").where(F.col("n") != F.length("text")).count()
    assert bad == 0
    # restart: nothing new, nothing repeated
    q2 = start_scoring_stream(
        spark, SF001, schema, "text", ["doc_id"], lengths, [T.StructField("n", T.LongType())],
        os.path.join(tmp_out, "out"), os.path.join(tmp_out, "ckpt"), glob="documents.parquet",
    )
    q2.awaitTermination(120)
    assert spark.read.parquet(os.path.join(tmp_out, "out")).count() == docs.count()


def test_parse_responses_on_batch(spark):
    df = spark.createDataFrame([("YES\n夜に 許容できない [TRUE] 最終判定 FALSE 7",)], "response string")
    r = parse_responses(df).first()
    assert (r.predicted_label, r.pred_is_ambiguous, r.pred_bracket, r.pred_stepwise, r.predicted_score) == (1, True, True, False, 7)
    assert (r.decision, r.added_info) == ("YES", "夜に 許容できない [TRUE] 最終判定 FALSE 7")


def test_materialize_cuts_lineage(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    m = materialize(df, "t_materialize")
    assert m.count() == 10 and "parquet" in m._jdf.queryExecution().executedPlan().toString().lower()
