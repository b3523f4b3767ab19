"""Python workers and term pools over larger tables: bounded batches, work done once, texts cut down before the rules read them."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelq.functions.rules import EXCLUDED_TERMS, KEYWORD_RULES
from labelq.operators.scoring import batch_score
from labelq.operators.vocab import extract_entities, extract_terms, regex_extractor, rule_characters, vocab_long, vocab_pools
from labelq.session import BATCH_BYTES, BATCH_SETTING


@pytest.fixture
def unset(spark):
    spark.conf.unset(BATCH_SETTING)
    yield
    spark.conf.unset(BATCH_SETTING)


def test_scorer_batches_are_bounded(spark, unset):
    rows = spark.range(400, numPartitions=1).select("id", F.repeat(F.lit("x"), 50_000).alias("text"))
    out = batch_score(rows, "text", ["id"], lambda texts: [{"n": len(t)} for t in texts], [T.StructField("n", T.LongType())], pause_s=0.0)
    assert spark.conf.get(BATCH_SETTING) == BATCH_BYTES
    assert out.where("n = 50000 AND status = 'ok'").count() == 400


def test_extractor_batches_are_bounded(spark, unset):
    rows = spark.createDataFrame([(1, "朝に")], "id long, text string")
    out = extract_entities(rows, "id", "text", extractor=lambda t: [("tag", t)])
    assert spark.conf.get(BATCH_SETTING) == BATCH_BYTES
    assert [tuple(r)[:2] for r in out.select("id", "term").collect()] == [(1, "朝に")]


def test_pools_run_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(["c"] * b.num_rows), pa.array([f"t{i}" for i in b.column(0).to_pylist()])], names=["category", "term"])

    long = vocab_long(spark.range(100, numPartitions=2).mapInArrow(run, "category string, term string"))
    assert [(r.category, r["size"]) for r in vocab_pools(long).collect()] == [("c", 100)]
    assert seen.value == 100


def test_terms_of_squeezed_texts(spark):
    """Texts of word parts, marks, line breaks and long runs of other characters: the terms that the rules find in the whole text."""
    assert all(rule_characters(pat) for _, pat in KEYWORD_RULES)
    assert rule_characters(r"(\d+)") is None and rule_characters(r"(^|\s|[^、。])(cat|犬)(が|$)") is None
    r = random.Random(4)
    parts = ["友達", "朝", "月", "学校", "誰", "に", "が", "で", "から", "、", "。", "\n", " ", "a", "é", "long run of words é\n", "x\n", "\r\n", "😀😀😀", "犬"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(3000)] + ["朝\n", "朝x\n", "朝\n\n", "朝abc", "abc朝に", "a、朝に", "abcd、朝に", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = sorted(map(tuple, extract_terms(rows, "text", keep_cols=["id"]).collect()))
    # The rules as they are, over whole texts; a rule of another shape beside them keeps them whole as well.
    plain = [(cat, f"{pat}()") for cat, pat in KEYWORD_RULES]
    want = sorted(map(tuple, extract_terms(rows, "text", rules=plain, keep_cols=["id"]).collect()))
    assert got == want and len(got) > 500
    find = regex_extractor()
    python = sorted((i, c, t) for i, x in enumerate(texts) if "\r" not in x for c, t in find(x) if t not in EXCLUDED_TERMS.get(c, []))
    assert [g for g in got if "\r" not in texts[g[0]]] == python
    assert "regexp_replace" in extract_terms(rows, "text")._jdf.queryExecution().optimizedPlan().toString()
