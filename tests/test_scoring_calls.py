"""Halving of failed calls, the pace of a whole job, routing past the scorer."""

import os
import time

import pytest
from pyspark.sql import functions as F

from labelq.operators.scoring import Pacer, RateLimited, ServiceError, batch_score, call_by_halves, gated_scoring
from tests.test_scoring_vocab import FIELDS, echo_scorer


def picky(texts):
    if any("bad" in t for t in texts):
        raise ServiceError("unavailable")
    return echo_scorer(texts)


def test_one_bad_row_fails_alone():
    calls = []

    def counted(texts):
        calls.append(len(texts))
        return picky(texts)

    batch = [f"t{i}" for i in range(50)]
    batch[17] = "bad"
    results, attempts = call_by_halves(counted, batch, max_retries=3, sleep=lambda s: None)
    assert [r is None for r in results] == [i == 17 for i in range(50)]
    assert attempts == [3 if i == 17 else 1 for i in range(50)]
    assert len(calls) <= 2 * 3 + 2 * 6
    assert call_by_halves(lambda t: [], ["a", "b"], sleep=lambda s: None)[0] == [None, None]  # wrong number of results
    assert call_by_halves(picky, [], sleep=lambda s: None) == ([], [])


def test_status_does_not_depend_on_the_calls(spark):
    df = spark.range(0, 300).select(F.col("id").alias("k"), F.when(F.col("id") % 11 == 0, "bad").otherwise(F.col("id").cast("string")).alias("t"))
    seen = set()
    for size, parts in ((1, 3), (7, 1), (50, 5), (400, 2)):
        out = batch_score(df.repartition(parts), "t", ["k"], picky, FIELDS, batch_size=size, max_retries=2, pause_s=0.0, sleep=lambda s: None)
        seen.add(tuple(sorted((r.k, r.response, r.status, r.attempts) for r in out.fillna("-").collect())))
    assert len(seen) == 1
    assert all((s == "failed") == (k % 11 == 0) for k, _, s, _ in seen.pop())


def test_transient_errors_are_retried_whole():
    left = [2]

    def limited(texts):
        if left[0]:
            left[0] -= 1
            raise RateLimited()
        return echo_scorer(texts)

    assert call_by_halves(limited, ["a", "b", "c"], sleep=lambda s: None) == (echo_scorer(["a", "b", "c"]), [3, 3, 3])


def test_pacer_keeps_its_interval():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pacer = Pacer(2.0, 1.0, sleep, lambda: now[0])
    at = []
    for work in (0.5, 5.0, 0.1, 0.1):
        pacer.wait()
        at.append(now[0])
        now[0] += work
    assert at == [1.0, 3.0, 8.0, 10.0] and slept == pytest.approx([1.0, 1.5, 1.9])


def test_calls_of_a_job_share_one_pace(spark, tmp_out):
    log = os.path.join(tmp_out, "calls")

    def timed(texts):
        with open(log, "a") as f:
            f.write(f"{time.time()}\n")
        return echo_scorer(texts)

    df = spark.range(0, 40).select(F.col("id").alias("k"), F.lit("x").alias("t")).repartition(11)
    out = batch_score(df, "t", ["k"], timed, FIELDS, batch_size=2, pause_s=0.1, paced_tasks=4)
    assert out.rdd.getNumPartitions() == 4
    assert out.where("status = 'ok'").count() == 40
    with open(log) as f:
        at = sorted(map(float, f))
    # 20 calls or a few more (odd rests): ten a second over all four tasks, but for the first call of each, which may meet.
    assert len(at) >= 20 and at[-1] - at[0] >= 0.1 * (len(at) - 4) - 0.2
    assert all(sum(1 for t in at if lo <= t < lo + 1) <= 10 + 4 for lo in at)


def test_gated_rows_pass_in_one_scan(spark, tmp_out):
    path = os.path.join(tmp_out, "rows")
    spark.range(0, 30).select(F.col("id").alias("k"), F.concat(F.lit("t"), F.col("id")).alias("t"),
                              F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 3 == 0).alias("g")).write.parquet(path)
    df = spark.read.parquet(path)

    def scorer(texts):
        assert all(t is not None for t in texts)
        return echo_scorer(texts)

    run = lambda **more: gated_scoring(
        df, F.col("g"), F.col("t"), ["k"], scorer, FIELDS, {"answer": F.upper("response")}, {"answer": F.lit("Filtered")}, pause_s=0.0, batch_size=4, **more)
    rows = {r.k: (r.answer, r.phase, r.status) for r in run().collect()}
    gated = {k for k in range(30) if k % 3 == 0 and k % 7}
    assert rows == {k: ("Filtered", "gated", "skipped") if k in gated else (f"<T{k}>", "scored", "ok") for k in range(30)}
    assert {r.k for r in run(drop_gated=True).collect()} == set(range(30)) - gated
    assert run()._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
