"""The pipeline's stages on rows with null and repeated doc_ids: nothing is lost, nothing is multiplied."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from tests.conftest import SF001

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k string, copies int"


def sentence(seed, n=40):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(3000)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    near = sentence(1, 60)
    out = [(1, sentence(2)), (1, sentence(3)), (2, sentence(4)), (None, sentence(5)), (None, sentence(5)), (None, sentence(6)), (3, near), (4, near + " more"), (5, near),
           (2, sentence(4)), (6, None), (7, ""), (8, "two words")] + [(100 + i, sentence(100 + i)) for i in range(40)]
    return [(i, t, "en", None if i == 2 else f"s{(i or 0) % 3}", len(t or ""), "x", 9) for i, t in out]


def test_near_duplicates_lose_no_other_row(spark, rows):
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), SF001)
    assert out.columns == corpus_pipeline.COLUMNS
    kept = Counter((r.doc_id, r.text) for r in out.collect())
    assert kept == Counter({(i, t) for i, t, *_ in rows if i not in (4, 5)})


def test_mix_takes_every_row_at_most_twice(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    out = Counter((r.doc_id, r.text) for r in corpus_pipeline.mix(spark, docs, SF001).collect())
    given = Counter((i, t) for i, t, *_ in rows)
    assert set(out) <= set(given) and all(n <= 2 * given[x] for x, n in out.items())
    taken = sum(len((t or "").split()) * n for (_, t), n in out.items())
    total = sum(len((t or "").split()) * n for (_, t), n in given.items())
    assert abs(taken - 1.5 * total) <= 3 * 60
    assert {(6, None), (7, "")} <= set(out) and any(i is None for i, _ in out)
    assert out == Counter((r.doc_id, r.text) for r in corpus_pipeline.mix(spark, docs.repartition(5), SF001).collect())


def test_passages_keep_rows_without_an_id(spark, rows):
    out = corpus_pipeline.repeated_passages(spark, spark.createDataFrame(rows, SCHEMA), SF001)
    got = Counter((r.doc_id, r.text) for r in out.collect())
    gone = {(5, rows[6][1]), (6, None), (7, "")}  # a whole copy of 3, and the blank ones
    assert all(got[(i, t)] == n for (i, t), n in Counter((i, t) for i, t, *_ in rows).items() if (i, t) not in gone and i != 4)
    assert (4, " more") in got or (4, "more") in got or any(i == 4 and len(t) < 60 for i, t in got)
    assert not any(x in got for x in gone)
