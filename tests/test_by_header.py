"""Scans by header: S1, S2, S5, S6 over files whose columns differ in order, presence and spelling."""

import os

import pytest

from labelq.sources.by_header import Field, first_record, list_files, read_by_header, read_header
from labelq.sources.io import read_many
from labelq.sources.tree import choose_files, read_result_tree
from tests.test_sources import write

FIELDS = [Field("Original_ID", "bigint"), Field("pred_is_ambiguous", "boolean", required=False), Field("predicted_score", "int", required=False),
          Field("response", required=False, aliases=("llm_raw_response", "response_text"))]


def test_columns_are_bound_by_name(spark, tmp_out):
    a, b, c = (os.path.join(tmp_out, f"{x}.csv") for x in "abc")
    write(a, '﻿Original_ID,sent,pred_is_ambiguous,llm_raw_response\n1,x,True,"two\nlines, ""q"""\n2,y,maybe,z\n')
    write(b, "predicted_score,stale,Original_ID\n7.0,1,3\n,2,4\n7.5,3,5\nnan,4,6\nx,5,7\n")
    write(c, 'response,"Original_ID "\nr,8,too,many\n')
    got = read_by_header(spark, [a, b, c], FIELDS).rows
    assert got.columns == ["Original_ID", "pred_is_ambiguous", "predicted_score", "response", "_file", "_part", "_bad"]
    rows = {r.Original_ID: (r.pred_is_ambiguous, r.predicted_score, r.response, r._part, [tuple(x) for x in r._bad]) for r in got.collect()}
    assert rows == {
        1: (True, None, 'two\nlines, "q"', 0, []), 2: (None, None, "z", 0, [("pred_is_ambiguous", "maybe")]),
        3: (None, 7, None, 1, []), 4: (None, None, None, 1, []), 5: (None, None, None, 1, [("predicted_score", "7.5")]),
        6: (None, None, None, 1, []), 7: (None, None, None, 1, [("predicted_score", "x")]), 8: (None, None, "r", 2, [("*", "r,8,too,many")])}


def test_one_scan_per_layout(spark, tmp_out):
    for i in range(12):
        write(os.path.join(tmp_out, f"f{i}.csv"), f"Original_ID,response\n{i},a\n" if i % 2 else f"response,Original_ID\na,{i}\n")
    rows = read_by_header(spark, tmp_out, FIELDS).rows
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2
    assert sorted(r.Original_ID for r in rows.where("response = 'a'").collect()) == list(range(12))


def test_missing_and_unreadable_files(spark, tmp_out):
    good, lacking, blank, open_quote = (os.path.join(tmp_out, f"{x}.csv") for x in ("good", "lacking", "blank", "open"))
    write(good, "Original_ID\n1\n")
    write(lacking, "ID,sent\n1,a\n")
    write(blank, "")
    write(open_quote, 'Original_ID,"sent\n1,a\n')
    paths = [good, lacking, blank, open_quote, os.path.join(tmp_out, "none.csv")]
    with pytest.raises(ValueError, match="Original_ID") as why:
        read_by_header(spark, paths, FIELDS)
    assert all(name in str(why.value) for name in ("lacking.csv", "blank.csv", "open.csv", "none.csv"))
    with pytest.warns(UserWarning, match="skipped"):
        scan = read_by_header(spark, paths, FIELDS, on_unreadable="skip")
    assert len(scan.skipped) == 4 and [r.Original_ID for r in scan.rows.collect()] == [1]
    with pytest.warns(UserWarning):
        assert read_by_header(spark, paths[1:], FIELDS, on_unreadable="skip").rows is None
        assert [tuple(r) for r in read_many(spark, paths, "Original_ID long", tag_col="part").collect()] == [(1, 0)]


def test_headers(spark, tmp_out):
    p = os.path.join(tmp_out, "h.csv")
    write(p, '"a\nb","c, ""d""",e\n1,2,3\n')
    assert read_header(spark, p) == ("a\nb", 'c, "d"', "e")
    assert first_record([]) is None
    assert len(list_files(spark, tmp_out)) == 1


def test_result_tree_of_several_layouts(spark, tmp_out):
    root = os.path.join(tmp_out, "re sults+")
    write(f"{root}/m1/classification/v 01/results.csv", "Original_ID,pred_is_ambiguous\n1,TRUE\n")
    write(f"{root}/m1/classification/v 01/scoring_results.csv", "Original_ID,pred_is_ambiguous\n9,TRUE\n")
    write(f"{root}/m1/scoring/v02/scoring_results.csv", "predicted_score,Original_ID\n5.0,2\n")
    write(f"{root}/m+2/stepwise/v03/stepwise_results.csv/part-0.csv", "phase,pred_is_ambiguous,Original_ID\nx,False,3\n")
    write(f"{root}/model=a%2Fb/method=fewshot/prompt=v04/part-0.csv", "llm_raw_response,Original_ID\nr,4\n")
    write(f"{root}/m1/scoring/notes.csv", "x\n1\n")
    out = read_result_tree(spark, root, FIELDS)
    assert sorted((r.Original_ID, r.pred_is_ambiguous, r.predicted_score, r.response, r.model, r.method, r.prompt) for r in out.collect()) == [
        (1, True, None, None, "m1", "classification", "v 01"), (2, None, 5, None, "m1", "scoring", "v02"),
        (3, False, None, None, "m+2", "stepwise", "v03"), (4, None, None, "r", "a/b", "fewshot", "v04")]
    assert [r.Original_ID for r in read_result_tree(spark, root, FIELDS, models=["m1"], methods=["scoring"]).collect()] == [2]
    assert read_result_tree(spark, root, FIELDS, prompts=["nope"]).count() == 0
    assert choose_files(["file:/r/m/scoring/p/scoring_results.csv", "file:/x/y.csv"], "/r", method=["scoring"]) == ["file:/r/m/scoring/p/scoring_results.csv"]
