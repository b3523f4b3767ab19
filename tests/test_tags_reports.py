"""F17 rule tables, A17 pools of any size, K2 / K4 / K5 sinks."""

import os

import pytest
from pyspark.sql import functions as F

from labelq.operators.tags import MAX_RULES, RULES, TagRule, map_tags, rules_from
from labelq.operators.vocab import all_digits, extract_terms, vocab_long, vocab_pools, write_pools
from labelq.sources.io import assemble, figure, sections, with_bom_header, write_csv


def slots(spark, rows, rules=RULES, **more):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, extractor string, tag string, term string")
    out = {i: [] for i in range(len(rows))}
    for r in map_tags(df, all_digits("term"), rules, **more).collect():
        out[r.n].append(r.slot)
    return [out[i] for i in range(len(rows))]


def test_rules_of_three_extractors(spark):
    assert slots(spark, [
        ("ginza", "DATE", "昨日"), ("ginza", "DATE", "2024"), ("ginza", "GPE", "x" * 20), ("ginza", "GPE", "x" * 19), ("ginza", "MONEY", "円"), ("ginza", "DATE", ""),
        ("hf", "TIM", "朝"), ("hf", "ORG", "会社"), ("hf", "MISC", "物"), ("hf", "DATE", "2024"), ("hf", None, "x"),
        ("sudachi", "名詞,時相名詞,*", "朝"), ("sudachi", "名詞,時相名詞,*", "今朝"), ("sudachi", "名詞,普通名詞,副詞可能", "毎日"), ("sudachi", "名詞,普通名詞,一般", "学校"),
        ("sudachi", "代名詞,*,*", "彼"), ("sudachi", "代名詞,*,*", "これ"), ("sudachi", "動詞,*,*", "先生"), ("sudachi", "名詞,固有名詞,地名", "友達"), ("sudachi", "名詞", "x"),
        ("other", "DATE", "朝")]) == [
        ["when"], [], [], ["where"], [], [], ["when"], ["who"], [], ["when"], [],
        [], ["when"], ["when"], ["where"], ["who"], [], ["who"], ["where", "who"], [], []]


def test_priority_decides_for_exclusive_extractors(spark):
    rules = [TagRule("x", "late", 2, "A"), TagRule("x", "early", 1, "A,B"), TagRule("x", "early", 3, words=("t",))]
    rows = [("x", "A,B,C", "t"), ("x", "A", "t"), ("x", "Z", "t")]
    assert slots(spark, rows, rules, exclusive=()) == [["early", "late"], ["late", "early"], ["early"]]
    assert slots(spark, rows, rules, exclusive=("x",)) == [["early"], ["late"], ["early"]]
    assert slots(spark, rows, []) == [[], [], []]


def test_rules_kept_as_a_table(spark):
    schema = "extractor string, slot string, priority int, tag string, words array<string>, not_words array<string>, min_chars int, max_chars int, digits boolean"
    table = spark.createDataFrame([("x", "who", 0, None, ["a"], None, None, None, None), ("x", "when", 1, "T", None, None, 2, 3, False)], schema)
    rules = rules_from(table)
    assert rules == [TagRule("x", "who", 0, words=("a",)), TagRule("x", "when", 1, "T", min_chars=2, max_chars=3, digits=False)]
    with pytest.raises(ValueError, match="tag rules"):
        rules_from(spark.range(MAX_RULES + 1).select(F.lit("x").alias("extractor"), F.lit("y").alias("slot"), F.col("id").cast("int").alias("priority"),
                                                     *[F.lit(None).cast(t).alias(n) for n, t in (x.split(" ", 1) for x in schema.split(", ")[3:])]))


def test_pools(spark, tmp_out):
    long = vocab_long(spark.createDataFrame([("a", "z"), ("a", "b"), ("b", "c")], "category string, term string"),
                      spark.createDataFrame([("a", "b"), ("c", "d")], "category string, term string"))
    assert {r.category: (r.terms, r.size) for r in vocab_pools(long).collect()} == {"a": (["b", "z"], 2), "b": (["c"], 1), "c": (["d"], 1)}
    with pytest.raises(ValueError, match="'a'"):
        vocab_pools(long, max_terms=1)
    path = os.path.join(tmp_out, "pools")
    write_pools(long, path)
    lines = []
    for name in sorted(f for f in os.listdir(path) if f.startswith("part-")):
        with open(os.path.join(path, name), encoding="utf-8") as f:
            lines += f.read().splitlines()
    assert lines == [f'{{"category":"{c}","term":"{t}"}}' for c, t in [("a", "b"), ("a", "z"), ("b", "c"), ("c", "d")]]


def test_long_terms_of_own_rules(spark):
    df = spark.createDataFrame([("[" + "t" * 25 + "] [123]",)], "text string")
    rules = [("any", r"(\[)([^\]]+)(\])")]
    assert extract_terms(df, "text", rules, {}).count() == 0
    assert sorted(r.term for r in extract_terms(df, "text", rules, {}, filter_terms=False).collect()) == ["123", "t" * 25]


def test_reports_and_headers(spark, tmp_out):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", None, None)], "run string, n int, x double")
    parts = sections(df, ["run"], 1, ["second", figure("n", F.col("n"))]).unionByName(sections(df, ["run"], 0, [F.col("run"), figure("x", F.col("x"), 4)]))
    got = {r.run: r.report for r in assemble(parts, ["run"]).collect()}
    assert got["a"] == f"a\n {'x':<24}: 0.5000\n\nsecond\n {'n':<24}: 1" and got["b"].count(": nan") == 2
    path = os.path.join(tmp_out, "bom")
    write_csv(with_bom_header(df).coalesce(1), path)
    name = next(f for f in os.listdir(path) if f.startswith("part-"))
    with open(os.path.join(path, name), "rb") as f:
        assert f.read().startswith(b"\xef\xbb\xbfrun,n,x")


def test_partitioned_sink_writes_few_files(spark, tmp_out):
    df = spark.range(0, 4000).select(F.col("id"), (F.col("id") % 3).cast("string").alias("part"), F.lit("  kept  ").alias("s")).repartition(16)
    path = os.path.join(tmp_out, "few")
    write_csv(df, path, partition_by=["part"])
    assert all(len([f for f in os.listdir(os.path.join(path, f"part={p}")) if f.startswith("part-")]) <= 2 for p in range(3))
    assert spark.read.option("header", "true").csv(path).where("s = '  kept  '").count() == 4000
