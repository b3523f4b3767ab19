"""Properties and literal cases."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from labelq.operators.ids import dense_ids, hex_bucket, pair_join, pair_missing, range_bucket
from labelq.operators.resolve import resolve_final, step_counts, subset_by_ids
from labelq.operators.sampling import (
    order_key,
    sample_n,
    shuffle_renumber,
    split_summary,
    stratified_sample,
    train_test_split,
)


def test_dense_ids_equal_global_row_number(spark):
    df = spark.range(0, 5000).withColumn("k", (F.col("id") * 7919) % 5003)
    for parts in (1, 17):
        x = df.repartition(parts)
        ours = dense_ids(x, ["k", "id"], range_bucket("k", 97), id_col="rid")
        ref = x.withColumn("rid2", F.row_number().over(Window.orderBy("k", "id")))
        bad = ours.join(ref, ["id", "k"]).where("rid != rid2").count()
        assert bad == 0
        ids = sorted(r.rid for r in ours.collect())
        assert ids == list(range(1, 5001))


def test_shuffle_is_partition_independent(spark):
    df = spark.range(0, 2000).withColumnRenamed("id", "doc_id")
    a = {r.doc_id: r.ID for r in shuffle_renumber(df.repartition(1), "doc_id").collect()}
    b = {r.doc_id: r.ID for r in shuffle_renumber(df.repartition(13), "doc_id").collect()}
    assert a == b and sorted(a.values()) == list(range(1, 2001))
    s1 = [r.doc_id for r in sample_n(df.repartition(1), "doc_id", 50).collect()]
    s2 = [r.doc_id for r in sample_n(df.repartition(9), "doc_id", 50).collect()]
    assert s1 == s2 and len(set(s1)) == 50
    assert sample_n(df, "doc_id", 5000).count() == 2000  # fewer than n: everything


def test_stratified_and_split(spark):
    df = spark.range(0, 600).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).alias("cls"))
    train, test = train_test_split(df, "doc_id", "cls", {True: 5, False: 95})
    tr = train.collect()
    assert len(tr) == 100 and sum(r.cls for r in tr) == 5
    te = {r.doc_id for r in test.collect()}
    assert te.isdisjoint({r.doc_id for r in tr}) and len(te) == 500
    s = split_summary(train, test, "cls").first()
    assert (s.train_rows, s.train_true, s.test_rows) == (100, 5, 500)
    small = stratified_sample(df.where("doc_id < 25"), "doc_id", "cls", {True: 5, False: 95})
    assert small.count() == 25  # smaller classes are taken whole


def test_stratified_plans_group_limit(spark):
    df = spark.range(0, 100).select(F.col("id").alias("doc_id"), (F.col("id") % 2 == 0).alias("cls"))
    plan = stratified_sample(df, "doc_id", "cls", {True: 3, False: 3})._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_pair_join_and_missing(spark):
    df = spark.createDataFrame([(i, f"s{i}") for i in range(0, 8)], "doc_id long, sent string")
    p = {r.doc_id: r.pair_id for r in pair_join(df, "doc_id", ["sent"]).collect()}
    assert p == {1: 2, 2: 1, 3: 4, 4: 3, 5: 6, 6: 5}
    assert sorted((r.doc_id, r.pair_id) for r in pair_missing(df, "doc_id").collect()) == [(0, -1), (7, 8)]


def test_pair_join_rejects_duplicates(spark):
    df = spark.createDataFrame([(3, "a"), (3, "b"), (4, "c")], "doc_id long, sent string")
    with pytest.raises(Exception):
        pair_join(df, "doc_id", ["sent"]).collect()


def _steps(spark):
    step1 = spark.createDataFrame(
        [(1, "t1", "L", "a1", 1), (2, "t2", "L", "a2", 2), (3, "t3", "L", "a3", 3), (4, "t4", "L", "a4", 4)],
        "doc_id long, target_sent string, target_label_str string, augmented_sent string, _pos long",
    )
    step2 = spark.createDataFrame(
        [(1, "b1", 1, 1), (2, "b2", 0, 2), (3, "b3", 1, 3), (1, "dup", 0, 9)],
        "doc_id long, augmented_sent_step2 string, is_ok_step2 int, _pos long",
    )
    step3 = spark.createDataFrame([(3, "m3", 1)], "doc_id long, final_manual_sent string, _pos long")
    return step1, step2, step3


def test_resolve_precedence(spark):
    s1, s2, s3 = _steps(spark)
    out = {r.doc_id: (r.final_sent, r.source) for r in resolve_final(s1, s2, s3).collect()}
    assert out == {1: ("b1", "step2"), 2: ("a2", "step1"), 3: ("m3", "step3"), 4: ("a4", "step1")}
    c = step_counts(resolve_final(s1, s2, s3)).first()
    assert (c.total, c.step1, c.step2, c.step3) == (4, 2, 1, 1)
    none = {r.doc_id: r.source for r in resolve_final(s1, None, None).collect()}
    assert set(none.values()) == {"step1"}
    ids = spark.createDataFrame([(1,), (3,)], "doc_id long")
    sub = step_counts(subset_by_ids(resolve_final(s1, s2, s3), ids, "doc_id")).first()
    assert (sub.total, sub.step2, sub.step3) == (2, 1, 1)


def test_order_key_matches_python_md5(spark):
    import hashlib

    df = spark.createDataFrame([(7,)], "k long")
    assert df.select(order_key("k")).first()[0] == hashlib.md5(b"7-42").hexdigest()
    assert df.select(hex_bucket(order_key("k"))).first()[0] == int(hashlib.md5(b"7-42").hexdigest()[:4], 16)


def test_dense_ids_keep_null_keys_without_holes(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", 3), (None, 4)], "lang string, doc_id long")
    out = dense_ids(df, ["lang", "doc_id"], F.col("lang")).collect()
    assert [(r["doc_id"], r["ID"]) for r in sorted(out, key=lambda r: r["ID"])] == [(2, 1), (4, 2), (1, 3), (3, 4)]


def test_pair_join_large_ids_and_unprunable_duplicate_check(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big + i, f"t{i}") for i in range(6)], "doc_id long, sent string")
    got = {r["doc_id"] - big: r["pair_sent"] for r in pair_join(df, "doc_id", ["sent"]).collect()}
    assert got == {0: "t1", 1: "t0", 2: "t3", 3: "t2", 4: "t5", 5: "t4"}
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, sent string")
    with pytest.raises(Exception, match="duplicate doc_id"):
        pair_join(twice, "doc_id", ["sent"]).select("doc_id", "pair_sent").collect()
