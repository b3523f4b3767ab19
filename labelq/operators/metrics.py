"""Quadrants, confusion cells, confusion matrices and classification metrics for many runs
in one grouped aggregate (P15-P17, A9-A14, A16, A20).

All ratios are double / double of integer counts, computed after the aggregate, so they are
exact up to the final division and independent of partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelq.functions.text import col_of


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; NULL when den = 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio0(num: Column, den: Column) -> Column:
    """num / den as double; 0.0 when den = 0 (zero_division = 0)."""
    return F.coalesce(ratio(num, den), F.lit(0.0))


def quadrant(label: Column | str, flagged: Column | str) -> Column:
    """A = NG + safe, B = OK + flagged, C = NG + flagged, D = OK + safe.

    NULL flags (unmapped text, null rule 3) fall out of every quadrant."""
    lab, flg = col_of(label), col_of(flagged)
    return (
        F.when((lab == 1) & ~flg, F.lit("A"))
        .when((lab == 0) & flg, F.lit("B"))
        .when((lab == 1) & flg, F.lit("C"))
        .when((lab == 0) & ~flg, F.lit("D"))
    )


def confusion_cell(truth: Column | str, pred: Column | str) -> Column:
    """TP / FN / FP / TN of one row."""
    t, p = col_of(truth), col_of(pred)
    return (
        F.when(t & p, F.lit("TP"))
        .when(t & ~p, F.lit("FN"))
        .when(~t & p, F.lit("FP"))
        .when(~t & ~p, F.lit("TN"))
    )


def confusion_aggs(truth: Column | str, pred: Column | str) -> list[Column]:
    """The four cells and n as aggregate expressions (label order [True, False])."""
    t, p = col_of(truth), col_of(pred)
    return [
        F.count_if(t & p).alias("tp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(~t & ~p).alias("tn"),
        F.count(F.lit(1)).alias("n"),
    ]


def with_metrics(df: DataFrame) -> DataFrame:
    """A10 on top of A9 counts: accuracy, precision, recall, F1 (zero division = 0)."""
    tp, fn, fp, tn, n = (F.col(c) for c in ("tp", "fn", "fp", "tn", "n"))
    return df.withColumns(
        {
            "accuracy": ratio(tp + tn, n),
            "precision": ratio0(tp, tp + fp),
            "recall": ratio0(tp, tp + fn),
            "f1": ratio0(tp * 2, tp * 2 + fp + fn),
        }
    )


def confusion_by(df: DataFrame, group_cols: Sequence[str], truth: str, pred: str) -> DataFrame:
    """A9 + A10 for every group (run x truth type) in one aggregate: one shuffle of
    partial aggregates, never of rows."""
    return with_metrics(df.groupBy(*group_cols).agg(*confusion_aggs(truth, pred)))


def gate_aggs(gated: Column | str, truth: Column | str) -> list[Column]:
    """A12 counts as aggregate expressions (to share one aggregate with A9)."""
    g, t = col_of(gated), col_of(truth)
    return [F.count_if(g).alias("filtered_total"), F.count_if(g & t).alias("filtered_ambiguous")]


def with_gate_rates(df: DataFrame) -> DataFrame:
    total, amb = F.col("filtered_total"), F.col("filtered_ambiguous")
    return df.withColumns(
        {"filter_success_rate": ratio0(total - amb, total), "filter_risk_rate": ratio0(amb, total)}
    )


def gate_analysis(df: DataFrame, group_cols: Sequence[str], gated: str, truth: str) -> DataFrame:
    """Gated total, truly ambiguous among the gated, success and risk rates (0 if none)."""
    return with_gate_rates(df.groupBy(*group_cols).agg(*gate_aggs(gated, truth)))


def score_crosstab(
    df: DataFrame, group_cols: Sequence[str], score: str, truth: str, lo: int = 0, hi: int = 10
) -> DataFrame:
    """Per group, one row per score lo..hi (all present), False / True counts, Total,
    True_Ratio (NULL when Total = 0). Rows with a NULL score are left out (null rule 7)."""
    # one scan and one partial aggregate per group: two counts per score, turned into rows
    grid = range(lo, hi + 1)
    counts = df.groupBy(*group_cols).agg(
        F.array(*[F.struct(F.lit(s).alias(score), F.count_if((F.col(score) == s) & ~F.col(truth)).alias("False"),
                           F.count_if((F.col(score) == s) & F.col(truth)).alias("True")) for s in grid]).alias("_rows")
    )
    out = counts.select(*group_cols, F.inline("_rows"))
    total = F.col("False") + F.col("True")
    return out.withColumns({"Total": total, "True_Ratio": ratio(F.col("True"), total)})


def score_histogram(
    df: DataFrame, group_cols: Sequence[str], score: str, truth: str, bins: int = 11, lo: float = 0.0, hi: float = 11.0
) -> DataFrame:
    """Counts in `bins` equal bins over [lo, hi], last bin closed, split by truth."""
    width = (hi - lo) / bins
    s = F.col(score).cast("double")
    idx = F.least(F.floor((s - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    inside = s.isNotNull() & (s >= lo) & (s <= hi)
    return (
        df.where(inside)
        .groupBy(*group_cols, idx.alias("bin"), F.col(truth).alias("truth"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumns(
            {
                "bin_lo": F.lit(lo) + F.col("bin").cast("double") * F.lit(width),
                "bin_hi": F.lit(lo) + (F.col("bin") + 1).cast("double") * F.lit(width),
            }
        )
    )
