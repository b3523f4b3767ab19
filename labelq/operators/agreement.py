"""Rater merge and agreement.

Raters arrive in long form ``(id, rater, raw_flag)``: one shuffle (``groupBy(id)`` with one
conditional aggregate per rater) merges any number of raters, instead of one join per rater. All
agreement statistics need only integer sums, so they come from one global aggregate whose
partial sums are combined map-side; kappas are closed forms over those sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelq.functions.normalize import to_bool_lenient
from labelq.operators.metrics import ratio


def flag_col(rater: str) -> str:
    return f"flag_{rater}"


def merge_raters(
    long_df: DataFrame,
    raters: Sequence[str],
    id_col: str = "doc_id",
    rater_col: str = "rater",
    raw_col: str = "raw_flag",
    how: str = "inner",
) -> DataFrame:
    """One row per id with ``flag_<rater>`` booleans.

    ``how='inner'``: ids present for every rater (the inner join chain).
    ``how='left'``: ids present for the first rater; absent ratings count as False
    (blank flag = False, null rule 2).
    Flags are normalised with the lenient P7 form before merging.
    """
    norm = long_df.select(
        F.col(id_col), F.col(rater_col), to_bool_lenient(raw_col).cast("int").alias("_f")
    )
    # explicit rater list: one conditional aggregate per rater, partial aggregation map-side,
    # one shuffle on the id (a pivot would plan two)
    wide = norm.groupBy(id_col).agg(
        *[F.max(F.when(F.col(rater_col) == r, F.col("_f"))).alias(r) for r in raters],
        *[F.count_if(F.col(rater_col) == r).alias(f"_n_{r}") for r in raters],
    )
    if how == "inner":
        keep = F.lit(True)
        for r in raters:
            keep = keep & (F.col(f"_n_{r}") > 0)
    elif how == "left":
        keep = F.col(f"_n_{raters[0]}") > 0
    else:
        raise ValueError(f"unsupported how={how!r}")
    return wide.where(keep).select(
        id_col, *[F.coalesce(F.col(r) == 1, F.lit(False)).alias(flag_col(r)) for r in raters]
    )


def with_votes(df: DataFrame, raters: Sequence[str], n_configured: int | None = None) -> DataFrame:
    """A1-A3: vote count, ratio, majority (>= n // 2 + 1) and union (>= 1).

    Divisor and threshold use the configured rater count, even when a rater's file was
    skipped (as the reference does)."""
    n = n_configured or len(raters)
    votes = sum((F.col(flag_col(r)).cast("int") for r in raters), F.lit(0))
    return df.withColumns(
        {
            "votes": votes,
            "vote_ratio": votes.cast("double") / F.lit(float(n)),
            "n_raters": F.lit(n),
            "gt_majority": votes >= F.lit(n // 2 + 1),
            "gt_union": votes >= F.lit(1),
        }
    )


def default_pairs(raters: Sequence[str]) -> list[tuple[str, str]]:
    """Consecutive pairs closing the ring: (a, b), (b, c), (c, a)."""
    rs = list(raters)
    return list(pairwise(rs)) + ([(rs[-1], rs[0])] if len(rs) > 2 else [])


def _pair_counts(a: str, b: str) -> list:
    fa, fb = F.col(flag_col(a)), F.col(flag_col(b))
    p = f"{a}_{b}"
    return [
        F.count_if(fa & fb).alias(f"n11_{p}"),
        F.count_if(fa & ~fb).alias(f"n10_{p}"),
        F.count_if(~fa & fb).alias(f"n01_{p}"),
        F.count_if(~fa & ~fb).alias(f"n00_{p}"),
    ]


def cohen_kappa(n11, n10, n01, n00):
    """Cohen's kappa from the 2x2 counts of a pair (NULL when expected agreement is 1)."""
    n = (n11 + n10 + n01 + n00).cast("double")
    po = ratio(n11 + n00, n)
    pe = ratio((n11 + n10) * (n11 + n01) + (n01 + n00) * (n10 + n00), n * n)
    return F.try_divide(po - pe, F.lit(1.0) - pe)


def agreement_sums(df: DataFrame, raters: Sequence[str], pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """One global aggregate holding every integer sum the agreement report needs."""
    k = len(raters)
    v = F.col("votes")
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.count_if((v == 0) | (v == k)).alias("n_complete"),
        F.sum(F.greatest(v, F.lit(k) - v)).cast("bigint").alias("sum_agree"),
        F.sum(v).cast("bigint").alias("sum_v"),
        F.sum(v * v + (F.lit(k) - v) * (F.lit(k) - v)).cast("bigint").alias("sum_sq"),
        F.count_if(F.col("gt_majority")).alias("majority_true"),
        F.count_if(F.col("gt_union")).alias("union_true"),
    ]
    aggs += [F.count_if(F.col(flag_col(r))).alias(f"true_{r}") for r in raters]
    for a, b in default_pairs(raters) if pairs is None else pairs:
        aggs += _pair_counts(a, b)
    return df.agg(*aggs)


def fleiss_kappa(n, k: int, sum_v, sum_sq):
    """Fleiss' kappa for two categories from integer sums (closed form)."""
    nk = n.cast("double") * F.lit(float(k))
    p_bar = ratio(sum_sq - n * F.lit(k), nk * F.lit(float(k - 1)))
    p1 = ratio(sum_v, nk)
    pe = p1 * p1 + (F.lit(1.0) - p1) * (F.lit(1.0) - p1)
    return F.try_divide(p_bar - pe, F.lit(1.0) - pe)


def agreement_report(df: DataFrame, raters: Sequence[str], pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """One row with agreement rates, pairwise and Fleiss kappa, totals per rater."""
    k = len(raters)
    pairs = list(pairs or default_pairs(raters))
    s = agreement_sums(df, raters, pairs)
    n = F.col("n")
    kappas = [
        cohen_kappa(*(F.col(f"{c}_{a}_{b}") for c in ("n11", "n10", "n01", "n00"))).alias(f"kappa_{a}_{b}")
        for a, b in pairs
    ]
    mean_kappa = sum((F.col(f"kappa_{a}_{b}") for a, b in pairs), F.lit(0.0)) / F.lit(float(len(pairs)))
    return (
        s.select(
            n,
            ratio(F.col("n_complete"), n).alias("complete_agreement_rate"),
            ratio(F.col("sum_agree"), n).alias("avg_agreement_number"),
            *kappas,
            fleiss_kappa(n, k, F.col("sum_v"), F.col("sum_sq")).alias("fleiss_kappa"),
            "majority_true",
            "union_true",
            *[f"true_{r}" for r in raters],
        )
        .withColumn("avg_pairwise_kappa", mean_kappa)
    )


def cohen_pairs(df: DataFrame, raters: Sequence[str], pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """A6 in long form: one row per rater pair with its 2x2 counts and kappa."""
    pairs = list(pairs or default_pairs(raters))
    s = agreement_sums(df, raters, pairs)
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("rater_1"),
                F.lit(b).alias("rater_2"),
                *[F.col(f"{c}_{a}_{b}").alias(c) for c in ("n11", "n10", "n01", "n00")],
            )
            for a, b in pairs
        ]
    )
    out = s.select(F.inline(rows))
    return out.withColumn("kappa", cohen_kappa(F.col("n11"), F.col("n10"), F.col("n01"), F.col("n00")))


def fleiss_report(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    """N, k and Fleiss' kappa."""
    k = len(raters)
    s = agreement_sums(df, raters, [])
    return s.select(
        "n",
        F.lit(k).alias("k"),
        "sum_v",
        "sum_sq",
        fleiss_kappa(F.col("n"), k, F.col("sum_v"), F.col("sum_sq")).alias("fleiss_kappa"),
    )
