"""Links that need more than one vector length, or rows that share a vec_id."""

import numpy as np

from labelq.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<double>, label int"


def result(spark, rows):
    df = spark.createDataFrame([(i, None if v is None else list(map(float, v)), 0) for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in embedding_dedup.near_duplicates(df).collect())


def test_every_length_is_compared(spark):
    rng = np.random.default_rng(1)
    long, short = rng.standard_normal((6, 16)), rng.standard_normal(8)
    rows = [(i, v) for i, v in enumerate(long)] + [(10, short), (11, short + 0.01 * rng.standard_normal(8)), (12, rng.standard_normal(3))]
    got = {r[0]: r[1:] for r in result(spark, rows)}
    assert got[10] == (1, 10, True) and got[11] == (1, 10, False) and got[12] == (0, 12, True)
    assert all(got[i] == (0, i, True) for i in range(6))


def test_rows_that_share_an_id_keep_their_links(spark):
    rng = np.random.default_rng(2)
    b, c = rng.standard_normal((2, 16))
    near = lambda v: v + 0.01 * rng.standard_normal(16)
    rows = [(5, b), (5, c), (9, c), (12, near(c)), (6, b), (13, near(b)), (20, None)]
    assert result(spark, rows) == [(5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False), (9, 2, 5, False), (12, 2, 5, False), (13, 2, 5, False), (20, 0, 20, True)]
    # An id of two vectors whose other rows have no vector of that id at all.
    assert result(spark, [(3, c), (3, b), (4, c)])[:3] == [(3, 0, 3, True), (3, 1, 3, True), (4, 1, 3, False)]
