"""Agreement and metrics against hand-computed values."""

import math

from pyspark.sql import functions as F

from labelq.operators import agreement as AG
from labelq.operators import metrics as M


def raters_long(spark, rows):
    """rows: (id, a, b, c) raw flags -> long form sheets"""
    data = [(i, r, v) for i, *vals in rows for r, v in zip("abc", vals)]
    return spark.createDataFrame(data, "doc_id long, rater string, raw_flag string")


def test_merge_inner_and_left(spark):
    long = raters_long(spark, [(1, "TRUE", " true", ""), (2, "FALSE", "TRUE", "TRUE")])
    extra = spark.createDataFrame([(3, "a", "TRUE")], "doc_id long, rater string, raw_flag string")
    m = AG.merge_raters(long.unionByName(extra), "abc")
    assert sorted(tuple(r) for r in m.collect()) == [(1, True, True, False), (2, False, True, True)]
    m2 = AG.merge_raters(long.unionByName(extra), "abc", how="left")
    assert (3, True, False, False) in [tuple(r) for r in m2.collect()]


def test_kappas_known_example(spark):
    # four items: votes 3, 0, 2, 1
    long = raters_long(spark, [(1, "TRUE", "TRUE", "TRUE"), (2, "", "", ""), (3, "TRUE", "TRUE", ""), (4, "", "TRUE", "")])
    v = AG.with_votes(AG.merge_raters(long, "abc"), "abc")
    rep = AG.agreement_report(v, "abc").first().asDict()
    assert rep["n"] == 4 and rep["majority_true"] == 2 and rep["union_true"] == 3
    assert rep["complete_agreement_rate"] == 0.5
    assert rep["avg_agreement_number"] == (3 + 3 + 2 + 2) / 4

    def cohen(x, y):
        n = len(x)
        po = sum(a == b for a, b in zip(x, y)) / n
        px, py = sum(x) / n, sum(y) / n
        pe = px * py + (1 - px) * (1 - py)
        return (po - pe) / (1 - pe)

    a, b, c = [1, 0, 1, 0], [1, 0, 1, 1], [1, 0, 0, 0]
    assert math.isclose(rep["kappa_a_b"], cohen(a, b))
    assert math.isclose(rep["kappa_b_c"], cohen(b, c))
    assert math.isclose(rep["kappa_c_a"], cohen(c, a))
    assert math.isclose(rep["avg_pairwise_kappa"], (cohen(a, b) + cohen(b, c) + cohen(c, a)) / 3)
    # Fleiss, as the reference computes it
    k, n = 3, 4
    votes = [3, 0, 2, 1]
    p_i = [(t * t + (k - t) ** 2 - k) / (k * (k - 1)) for t in votes]
    p1 = sum(votes) / (n * k)
    pe = p1 ** 2 + (1 - p1) ** 2
    assert math.isclose(rep["fleiss_kappa"], (sum(p_i) / n - pe) / (1 - pe))


def test_kappa_one_class_is_null(spark):
    long = raters_long(spark, [(1, "TRUE", "TRUE", "TRUE"), (2, "TRUE", "TRUE", "TRUE")])
    v = AG.with_votes(AG.merge_raters(long, "abc"), "abc")
    rep = AG.agreement_report(v, "abc").first()
    assert rep["kappa_a_b"] is None and rep["fleiss_kappa"] is None
    pairs = AG.cohen_pairs(v, "abc").collect()
    assert [(p.rater_1, p.rater_2) for p in pairs] == [("a", "b"), ("b", "c"), ("c", "a")]


def test_confusion_metrics_edge_cases(spark):
    rows = [
        ("all_correct", True, True), ("all_correct", False, False),
        ("no_pred_pos", True, False), ("no_pred_pos", False, False),
        ("no_truth_pos", False, True), ("no_truth_pos", False, False),
    ]
    df = spark.createDataFrame(rows, "run string, t boolean, p boolean")
    out = {r.run: r for r in M.confusion_by(df, ["run"], "t", "p").collect()}
    a = out["all_correct"]
    assert (a.tp, a.fn, a.fp, a.tn, a.accuracy, a.precision, a.recall, a.f1) == (1, 0, 0, 1, 1.0, 1.0, 1.0, 1.0)
    b = out["no_pred_pos"]
    assert (b.precision, b.recall, b.f1) == (0.0, 0.0, 0.0)
    c = out["no_truth_pos"]
    assert (c.precision, c.recall, c.f1, c.accuracy) == (0.0, 0.0, 0.0, 0.5)
    empty = M.confusion_by(df.where(F.lit(False)), [], "t", "p").first()
    assert empty.n == 0 and empty.accuracy is None and empty.f1 == 0.0


def test_quadrant_and_cell(spark):
    df = spark.createDataFrame([(1, False), (0, True), (1, True), (0, False), (1, None)], "l int, f boolean")
    assert [r[0] for r in df.select(M.quadrant("l", "f")).collect()] == ["A", "B", "C", "D", None]
    df2 = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "t boolean, p boolean")
    assert [r[0] for r in df2.select(M.confusion_cell("t", "p")).collect()] == ["TP", "FN", "FP", "TN"]


def test_crosstab_fills_missing_scores(spark):
    rows = [("r", 3, True), ("r", 3, False), ("r", 10, True), ("r", None, True)]
    df = spark.createDataFrame(rows, "run string, s int, t boolean")
    ct = {r.s: r for r in M.score_crosstab(df, ["run"], "s", "t").collect()}
    assert sorted(ct) == list(range(11))
    assert (ct[3]["False"], ct[3]["True"], ct[3].Total, ct[3].True_Ratio) == (1, 1, 2, 0.5)
    assert ct[0].Total == 0 and ct[0].True_Ratio is None
    assert sum(r.Total for r in ct.values()) == 3  # NULL score dropped
    # threshold 5 on the crosstab equals the confusion matrix at >= 5
    tp = sum(r["True"] for s, r in ct.items() if s >= 5)
    assert tp == 1


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([("r", 0.0, True), ("r", 10.0, False), ("r", 11.0, False), ("r", 12.0, True)], "run string, s double, t boolean")
    h = {(r.bin, r.truth): r.n for r in M.score_histogram(df, ["run"], "s", "t").collect()}
    assert h == {(0, True): 1, (10, False): 2}


def test_gate_analysis(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True)], "g boolean, t boolean")
    r = M.gate_analysis(df, [], "g", "t").first()
    assert (r.filtered_total, r.filtered_ambiguous, r.filter_success_rate, r.filter_risk_rate) == (2, 1, 0.5, 0.5)
    r0 = M.gate_analysis(df.where("NOT g"), [], "g", "t").first()
    assert (r0.filter_success_rate, r0.filter_risk_rate) == (0.0, 0.0)


def test_crosstab_keeps_a_run_without_scores(spark):
    df = spark.createDataFrame([("r", None, True), ("s", 3, True)], "run string, score int, truth boolean")
    out = M.score_crosstab(df, ["run"], "score", "truth").collect()
    assert len(out) == 22 and sum(r["True"] for r in out) == 1
