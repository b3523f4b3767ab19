"""P4 over levels, J5 with a lookup table, O1 / O6 ordered sinks."""

import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from labelq.operators.ids import bucket_offsets, dense_ids, pair_join, pair_lookup, pair_missing, range_levels
from labelq.sources.io import read_csv, read_in_order, write_ordered
from tests.test_plans import static_plans  # noqa: F401


def test_sparse_ids_equal_global_row_number(spark):
    rnd = random.Random(2)
    keys = [rnd.randrange(-(2**62), 2**62) for _ in range(1500)] + list(range(70000, 70400)) + [2**63 - 1, -(2**63), 0, -1, None, 5, 5]
    rows = [(p, k, i) for i, k in enumerate(keys) for p in ("b", "a") if (i + (p == "a")) % 3]
    df = spark.createDataFrame(rows, "part string, k long, n int").repartition(7)
    out = dense_ids(df, ["part", "k", "n"], [F.col("part"), *range_levels("k")], id_col="rid").collect()
    want = {r: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])))}
    assert {(r.part, r.k, r.n): r.rid for r in out} == want and len(out) == len(rows)


def test_levels_bound_every_window(spark):
    # Below the first level windows are partitioned: a level holds at most 2**16 buckets inside the one above.
    df = spark.range(10).select(F.col("id").alias("k"))
    levels = spark.createDataFrame([(2**40 + 3 * 2**16,)], "k long").select(*[c.alias(f"l{i}") for i, c in enumerate(range_levels("k"))]).first()
    assert tuple(levels) == (0, 2**8, 2**24 + 3)
    assert dense_ids(df.where("k < 0"), ["k"], range_levels("k")).count() == 0
    counts = spark.createDataFrame([(0, 5, 3), (0, 2, 4), (1, 0, 2), (None, 1, 7)], "a int, b int, n long")
    assert {(r.a, r.b): r.o for r in bucket_offsets(counts, ["a", "b"], "n", "o").collect()} == {(None, 1): 0, (0, 2): 7, (0, 5): 11, (1, 0): 14}


def test_only_the_first_level_is_in_one_partition(static_plans):  # noqa: F811
    lines = static_plans("union_renumber").split("\n")
    single = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert len(single) == 1 and "HashAggregate(keys=[_b0" in lines[single[0] + 1]


@pytest.mark.parametrize("max_ids", [1 << 20, 1])
def test_pair_lookup_finds_partners_that_are_no_targets(spark, max_ids):
    full = spark.createDataFrame([(i, f"s{i}", i % 2) for i in range(1, 9)] + [(100, "dup", 0), (100, "dup", 1), (None, "x", 0)], "ID long, sent string, label int")
    targets = spark.createDataFrame([(1, "t1"), (4, "t4"), (4, "again"), (9, "t9"), (None, "tn")], "ID long, note string")
    out = pair_lookup(targets, full, "ID", ["sent", "label"], max_ids=max_ids)
    assert out.columns == ["ID", "note", "pair_id", "pair_sent", "pair_label", "pair_found"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(1, "t1", 2, "s2", 0, True), (4, "t4", 3, "s3", 1, True), (4, "again", 3, "s3", 1, True), (9, "t9", 10, None, None, False),
         (None, "tn", None, None, None, False)], key=str)
    with pytest.raises(PySparkException, match="duplicate ID"):
        pair_lookup(spark.createDataFrame([(99,)], "ID long"), full, "ID", ["sent"], max_ids=max_ids).collect()
    assert pair_lookup(targets.where("false"), full, "ID", ["sent"], max_ids=max_ids).count() == 0


def test_few_targets_filter_the_lookup_before_its_shuffle(spark, tmp_out):
    full = spark.range(1, 2001).select(F.col("id").alias("ID"), F.repeat(F.lit("x"), 50).alias("sent"))
    full.write.parquet(os.path.join(tmp_out, "full"))
    lookup = spark.read.parquet(os.path.join(tmp_out, "full"))
    targets = spark.createDataFrame([(7,)], "ID long")
    plan = lambda n: pair_lookup(targets, lookup, "ID", ["sent"], max_ids=n)._jdf.queryExecution().executedPlan().toString()
    lines = plan(10).split("\n")
    semi = next(i for i, line in enumerate(lines) if "LeftSemi" in line)
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line)
    assert "BroadcastHashJoin" in lines[semi] and not any("Exchange" in line for line in lines[semi:scan])
    assert "LeftSemi" not in plan(0)


def test_rows_without_an_id_are_no_pair(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c"), (2, "d"), (5, "e")], "ID long, sent string")
    assert sorted(r.ID for r in pair_join(df, "ID", ["sent"]).collect()) == [1, 2]
    assert sorted(((r.ID, r.pair_id) for r in pair_missing(df, "ID").collect()), key=str) == [(5, 6), (None, None), (None, None)]


def test_ordered_sink_reads_back_in_order(spark, tmp_out):
    rnd = random.Random(1)
    ids = [rnd.randrange(10**9) for _ in range(3000)] + [7] * 20 + [None]
    df = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "Original_ID long, n int").repartition(9)
    path = os.path.join(tmp_out, "sorted")
    write_ordered(df, path, ["Original_ID", "n"], fmt="parquet", files=6)
    rows = sorted(read_in_order(spark, path).collect(), key=lambda r: (r._file, r._row))
    assert [(r.Original_ID, r.n) for r in rows] == sorted(((i, n) for n, i in enumerate(ids)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len({r._file for r in rows}) > 3
    text = os.path.join(tmp_out, "csv")
    write_ordered(df.where("Original_ID is not null"), text, ["Original_ID", "n"], files=4)
    lines = []
    for name in sorted(f for f in os.listdir(text) if f.startswith("part-")):
        lines += [r.Original_ID for r in read_csv(spark, os.path.join(text, name), "Original_ID long, n int").collect()]
    assert lines == sorted(i for i in ids if i is not None)
