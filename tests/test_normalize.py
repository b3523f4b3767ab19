"""P7, P8, P11, F19, F20 and the presence-guarded projections."""

import pytest
from pyspark.sql import functions as F

from labelq.functions import normalize as N
from labelq.functions.prompts import render_format, render_replace


def test_bool_forms(spark):
    vals = ["TRUE", " true ", "True", "FALSE", "", None, "1"]
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    rows = df.select(N.to_bool_lenient("x"), N.to_bool_strict("x")).collect()
    assert [r[0] for r in rows] == [True, True, True, False, False, False, False]
    assert [r[1] for r in rows] == [True, None, True, False, None, None, None]


def test_to_number_and_label_text(spark):
    df = spark.createDataFrame([("12",), ("x",), (None,), ("0",)], "x string")
    rows = df.select(N.to_number("x").alias("n")).select(
        "n", N.label_text("n").alias("t"), N.label_text_strict("n").alias("s")
    ).collect()
    assert [r.n for r in rows] == [12, None, None, 0]
    assert [r.t for r in rows] == ["許容できない", "許容できない", "許容できない", "許容できる"]
    assert [r.s for r in rows] == [None, None, None, "許容できる"]


def test_partner_and_names(spark):
    df = spark.createDataFrame([(1,), (2,), (0,), (999,)], "id long")
    assert [r[0] for r in df.select(N.partner_id("id")).collect()] == [2, 1, -1, 1000]
    m = spark.createDataFrame([("org/model-x", "p/v01_base.txt"), ("plain", ".hidden")], "m string, p string")
    rows = m.select(N.safe_name("m"), N.base_name("m"), N.stem_name("p")).collect()
    assert [tuple(r) for r in rows] == [("org_model-x", "model-x", "v01_base"), ("plain", "plain", ".hidden")]


def test_presence_guards(spark):
    df = spark.createDataFrame([(1, True, None)], "id long, a boolean, b boolean")
    assert N.select_present(df, ["b", "zz", "id"]).columns == ["b", "id"]
    assert N.add_blank_columns(df, ["a", "c"]).columns == ["id", "a", "b", "c"]
    assert df.select(N.any_of_present(df, ["a", "b", "missing"])).first()[0] is True
    assert N.columns_matching(df.withColumnRenamed("a", "Aのフラグ"), "のフラグ") == ["Aのフラグ"]
    with pytest.raises(ValueError):
        N.require_columns(df, ["sent"])
    assert "sent" in N.alias_first_present(df.withColumnRenamed("a", "text"), "sent", ["sent", "text"]).columns


def test_render_replace_is_sequential(spark):
    df = spark.createDataFrame([("a {label} b", 0)], "t string, l int")
    out = df.select(render_replace("S:{text}|L:{label}", F.col("t"), F.col("l"))).first()[0]
    assert out == "### 指示:\nS:a 許容できる b|L:許容できる\n\n### 応答:\n"


def test_render_format_is_not_rescanned(spark):
    df = spark.createDataFrame([("has {b} inside", None)], "a string, b string")
    out = df.select(render_format("{a}/{b}/{{x}}", a=F.col("a"), b=F.col("b"))).first()[0]
    assert out == "has {b} inside/None/{x}"
    with pytest.raises(KeyError):
        render_format("{zzz}", a=F.col("a"))


def test_observed_counts_and_null_drops(spark):
    df = spark.createDataFrame([(1, 5), (None, 3), (3, None), (4, 1)], "id long, score int")
    kept, obs = N.drop_null_keys(df, ["id", "score"], name="t_drop")
    assert kept.count() == 2
    assert obs.get == {"rows_in": 4, "dropped": 2}
    seen, o2 = N.observe_rows(df, "t_rows")
    seen.write.format("noop").mode("overwrite").save()
    assert o2.get["rows"] == 4


def test_rater_column_check(spark, capsys):
    df = spark.createDataFrame([(1, "TRUE", "")], "ID long, `Aのフラグ` string, `Bのフラグ` string")
    assert N.check_rater_columns(df, "のフラグ", ["A", "B"]) == ["Aのフラグ", "Bのフラグ"]
    assert N.check_rater_columns(df, "のフラグ", ["A", "B", "C"]) == ["Aのフラグ", "Bのフラグ"]
    assert "warning" in capsys.readouterr().out
