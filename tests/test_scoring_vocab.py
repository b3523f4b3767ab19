"""M1-M3, M5, M9, F21, F15-F17, A17."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelq.functions.rules import stand_in_column, stand_in_reply
from labelq.operators.scoring import RateLimited, ServiceError, batch_score, call_with_retry, gated_predict
from labelq.operators.vocab import extract_entities, extract_terms, vocab_long, vocab_pools

FIELDS = [T.StructField("response", T.StringType())]


def echo_scorer(texts):
    return [{"response": f"<{t}>"} for t in texts]


def test_batch_score_keys_survive_any_batch_size(spark):
    df = spark.range(0, 137).select(F.col("id").alias("k"), F.col("id").cast("string").alias("t")).repartition(5)
    for bs in (1, 7, 50, 500):
        out = batch_score(df, "t", ["k"], echo_scorer, FIELDS, batch_size=bs, pause_s=0.0).collect()
        assert len(out) == 137
        assert all(r.response == f"<{r.k}>" and r.status == "ok" for r in out)


def test_batch_score_empty_input(spark):
    df = spark.createDataFrame([], "k long, t string")
    assert batch_score(df, "t", ["k"], echo_scorer, FIELDS, pause_s=0.0).count() == 0


def test_retry_then_success_and_give_up():
    calls, waits = [], []

    def flaky(batch):
        calls.append(1)
        if len(calls) < 3:
            raise RateLimited()
        return echo_scorer(batch)

    res, attempts = call_with_retry(flaky, ["a"], sleep=waits.append)
    assert res == [{"response": "<a>"}] and attempts == 3 and waits == [2, 3]

    waits.clear()
    res, attempts = call_with_retry(lambda b: (_ for _ in ()).throw(ServiceError()), ["a"], max_retries=5, sleep=waits.append)
    assert res is None and attempts == 5 and waits == [5] * 5

    res, attempts = call_with_retry(lambda b: 1 / 0, ["a"], sleep=waits.append)
    assert res is None and attempts == 1  # unknown error gives up at once


def test_failed_batches_keep_rows(spark):
    def always_fail(batch):
        raise ServiceError("down")

    df = spark.range(0, 10).select(F.col("id").alias("k"), F.lit("x").alias("t"))
    out = batch_score(df, "t", ["k"], always_fail, FIELDS, max_retries=2, pause_s=0.0, sleep=lambda s: None).collect()
    assert sorted(r.k for r in out) == list(range(10))
    assert {r.status for r in out} == {"failed"} and {r.attempts for r in out} == {2}
    assert all(r.response is None for r in out)


def test_gated_predict(spark):
    df = spark.range(0, 6).select(F.col("id").alias("k"), F.col("id").cast("string").alias("t"))

    def scored(x):
        return batch_score(x, "t", ["k"], echo_scorer, FIELDS, pause_s=0.0)

    out = {r.k: r.response for r in gated_predict(df, F.col("k") < 2, scored, {"response": F.lit("Filtered")}).collect()}
    assert out == {0: "Filtered", 1: "Filtered", 2: "<2>", 3: "<3>", 4: "<4>", 5: "<5>"}


def test_stand_in_rules_python_equals_column(spark):
    prompts = [
        "「いつ」の情報が加わることで 信号が赤信号だったため車のアクセルを踏んだ",
        "「だれが」の情報が加わることで 友人の皿に料理を取り分けようとした時",
        "信号が赤信号だったため車のブレーキを踏んだ YES いつ",
        "YES どこで",
        "YES だれが いつ",
        "nothing",
    ]
    df = spark.createDataFrame([(p,) for p in prompts], "p string")
    assert [r[0] for r in df.select(stand_in_column("p")).collect()] == [stand_in_reply(p) for p in prompts]
    assert stand_in_reply(prompts[4]) == "YES\n夜中の３時"  # the when test comes first


def test_vocab_regex_fallback(spark):
    texts = [(1, "友達が朝に学校で話した"), (2, "誰が昨日、家に来た"), (3, "12月の公園"), (4, "no japanese here")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    terms = extract_terms(df, "text", keep_cols=["doc_id"])
    got = sorted((r.doc_id, r.category, r.term) for r in terms.collect())
    import re

    from labelq.functions.rules import KEYWORD_RULES

    want = set()
    for i, t in texts:
        for cat, pat in KEYWORD_RULES:
            for m in re.findall(pat, t):
                term = m[1].strip()
                if term and len(term) < 20 and not term.isdigit() and not (cat == "who" and term == "誰"):
                    want.add((i, cat, term))
    assert set(got) == want and want
    pools = {r.category: r.terms for r in vocab_pools(vocab_long(terms)).collect()}
    assert pools["who"] == ["友達"]
    ents = extract_entities(df, "doc_id", "text")
    assert {(r.doc_id, r.category, r.term) for r in ents.collect()} == want
