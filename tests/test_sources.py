"""S1, S2, S3, S4, S6, S7, S8 and sinks K1, K2, K5, K6."""

import os

from pyspark.sql import types as T

from labelq.sources.encodings import decode_first, read_csv_any_encoding
from labelq.sources.io import read_csv, read_many, read_optional, read_templates, with_bom_header, write_csv
from labelq.sources.tree import read_result_tree

SCHEMA = T.StructType([T.StructField("ID", T.LongType()), T.StructField("sent", T.StringType())])


def write(path, text, enc="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=enc, newline="") as f:
        f.write(text)


def test_csv_multiline_quotes_bom(spark, tmp_out):
    p = os.path.join(tmp_out, "a.csv")
    write(p, '﻿ID,sent\n1,"line1\nline2"\n2,"say ""hi"", ok"\n3,"a,b"\n')
    rows = {r.ID: r.sent for r in read_csv(spark, p, SCHEMA).collect()}
    assert rows == {1: "line1\nline2", 2: 'say "hi", ok', 3: "a,b"}


def test_read_many_skips_missing(spark, tmp_out):
    a, b = os.path.join(tmp_out, "x1.csv"), os.path.join(tmp_out, "x2.csv")
    write(a, "ID,sent\n1,a\n")
    write(b, "ID,sent\n2,b\n")
    df = read_many(spark, [a, os.path.join(tmp_out, "missing.csv"), b], SCHEMA, tag_col="part")
    assert sorted((r.ID, r.part) for r in df.collect()) == [(1, 0), (2, 2)]
    assert read_many(spark, [os.path.join(tmp_out, "nope.csv")], SCHEMA) is None
    assert read_optional(spark, os.path.join(tmp_out, "nope.csv"), SCHEMA).count() == 0


def test_encoding_fallback(spark, tmp_out):
    d = os.path.join(tmp_out, "enc")
    body = "ID,sent\n1,文章です①\n"
    write(os.path.join(d, "u8.csv"), body)
    write(os.path.join(d, "bom.csv"), "﻿" + body)
    write(os.path.join(d, "sj.csv"), "ID,sent\n1,文章です\n", "shift_jis")
    write(os.path.join(d, "cp.csv"), body, "cp932")
    write(os.path.join(d, "euc.csv"), "ID,sent\n1,文章です\n", "euc-jp")
    with open(os.path.join(d, "bad.csv"), "wb") as f:
        f.write(b"ID,sent\n1,\xff\xfe\xfd\x80\x81\n")
    out = {os.path.basename(r._file): (r._encoding, r.ID, r.sent) for r in read_csv_any_encoding(spark, d, SCHEMA).collect()}
    assert out["u8.csv"] == ("utf-8", 1, "文章です①")
    assert out["bom.csv"] == ("utf-8", 1, "文章です①")
    assert out["sj.csv"] == ("shift_jis", 1, "文章です")
    assert out["cp.csv"] == ("cp932", 1, "文章です①")
    # EUC-JP bytes also decode strictly as shift_jis (half-width katakana): the first strict
    # decode in the fixed order wins, as in the reference
    assert out["euc.csv"][0] == "shift_jis" and out["euc.csv"][2] != "文章です"
    assert out["bad.csv"] == (None, None, None) or out["bad.csv"][0] is not None
    assert decode_first("①".encode("cp932")) == ("cp932", "①")


def test_result_tree_and_templates(spark, tmp_out):
    root = os.path.join(tmp_out, "results")
    write(os.path.join(root, "m1", "classification", "v01", "results.csv"), "ID,sent\n1,a\n")
    write(os.path.join(root, "m1", "classification", "v01", "other.csv"), "ID,sent\n9,z\n")
    write(os.path.join(root, "m2", "stepwise", "v02", "stepwise_results.csv"), "ID,sent\n2,b\n")
    df = read_result_tree(spark, root, SCHEMA)
    assert sorted((r.model, r.method, r.prompt, r.ID) for r in df.collect()) == [
        ("m1", "classification", "v01", 1), ("m2", "stepwise", "v02", 2)]
    assert read_result_tree(spark, root, SCHEMA, models=["m2"]).count() == 1
    tdir = os.path.join(tmp_out, "tpl")
    write(os.path.join(tdir, "v01_base.txt"), "A {text}\nB {label}\n")
    t = read_templates(spark, tdir).first()
    assert t.name == "v01_base" and t.template == "A {text}\nB {label}"


def test_partitioned_split_sink_and_bom(spark, tmp_out):
    df = spark.createDataFrame([(1, "TP"), (2, "FN"), (3, "TP")], "ID long, cell string")
    out = os.path.join(tmp_out, "split")
    write_csv(df, out, partition_by=["cell"])
    assert sorted(x for x in os.listdir(out) if x.startswith("cell=")) == ["cell=FN", "cell=TP"]
    assert with_bom_header(df).columns[0] == "﻿ID"


def test_jobs_write_split_and_reports(spark, tmp_out):
    from labelq.plans.jobs import moderation_split, reevaluation_outputs
    from labelq.plans.queries import QUERIES
    from tests.conftest import SF001

    items = spark.createDataFrame(
        [(1, 1, "short"), (2, 0, "x" * 2000), (3, 1, "y" * 3000), (4, 0, "z")], "doc_id long, label int, text string"
    )
    res = moderation_split(items, lambda ts: [{"moderation_flagged": len(t) > 1000} for t in ts],
                           os.path.join(tmp_out, "mod"), name="t_mod")
    assert {r.doc_id: r.quadrant for r in res.collect()} == {1: "A", 2: "B", 3: "C", 4: "D"}
    assert sorted(x for x in os.listdir(os.path.join(tmp_out, "mod", "quadrants")) if x.startswith("quadrant=")) == [
        "quadrant=A", "quadrant=B", "quadrant=C", "quadrant=D"]
    reevaluation_outputs(QUERIES["reevaluate"](spark, SF001), os.path.join(tmp_out, "re"))
    assert os.path.isdir(os.path.join(tmp_out, "re", "metrics", "gt_type=gt_majority"))
    text = spark.read.text(os.path.join(tmp_out, "re", "reports"), wholetext=False).collect()
    assert any("Accuracy" in r.value for r in text)
