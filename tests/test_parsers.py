"""Literal cases for the parsers F1-F8 and the text helpers (FIXTURES.md part C)."""

from pyspark.sql import functions as F

from labelq.functions import parsers as P
from labelq.functions.text import py_strip


def one(spark, values, fn, schema="r string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(fn(F.col("r"))).collect()]


def test_parse_label_branches(spark):
    vals = ["許容できる", "許容できない", "許容できない、いや許容できる", "わからない", None]
    assert one(spark, vals, P.parse_label) == [0, 1, 1, -1, -1]


def test_parse_verdict_and_bracket(spark):
    vals = ["TRUE", "true", "[TRUE]", "FALSE", "not TRUE", "", None]
    assert one(spark, vals, P.parse_verdict) == [True, True, True, False, True, False, False]
    assert one(spark, vals, P.parse_bracket) == [False, False, True, False, False, False, False]


def test_parse_stepwise(spark):
    vals = [
        "考察\n最終判定: TRUE",
        "最終判定: FALSE ... 最終判定: TRUE",
        "TRUE かも\n最終判定: FALSE",
        "最終判定: 保留",
        "最終判定: 保留 but TRUE before? no: true",
        "no marker TRUE",
        "no marker",
    ]
    assert one(spark, vals, P.parse_stepwise) == [True, True, False, False, True, True, False]


def test_parse_score(spark):
    vals = ["7", "score: 12", "0", "none", "99999999999", "５", "3/10", "007", "  ８点 ", None, "-4"]
    assert one(spark, vals, P.parse_score) == [7, 10, 0, None, 10, 5, 3, 7, 8, None, 4]


def test_parse_yes_no(spark):
    vals = ["YES\ntext", "yes \n\n text ", "NO\ntext", "Sure.\nYES\nadded", "YES", None, "YES\n　全角\nmore"]
    out = one(spark, vals, P.parse_yes_no)
    assert [(r["decision"], r["text"]) for r in out] == [
        ("YES", "text"),
        ("YES", "text"),
        ("NO", "N/A"),
        ("YES", "added"),
        ("NO", "N/A"),
        ("NO", "N/A"),
        ("YES", "全角"),
    ]


def test_strip_echo_and_heading(spark):
    df = spark.createDataFrame(
        [("PROMPT (a+b)*\n　answer　", "PROMPT (a+b)*\n"), ("answer", "absent"), ("　　x\t", "")],
        "r string, p string",
    )
    got = [r[0] for r in df.select(P.strip_echo(F.col("r"), F.col("p"))).collect()]
    assert got == ["answer", "answer", "x"]
    h = [r[0] for r in df.select(P.strip_heading(F.lit(" シナリオA: 文 "))).limit(1).collect()]
    assert h == ["文"]


def test_py_strip_matches_python(spark):
    vals = ["  a b  ", "　x　", "\n\t y \r\n", " z ", "", "   "]
    assert one(spark, vals, py_strip) == [v.strip() for v in vals]


def test_parse_score_has_no_digit_count_switch(spark):
    got = one(spark, ["150", "1" * 60, "0150"], lambda c: P.parse_score(c, 0, 1000))
    assert got == [150, 1000, 150]
