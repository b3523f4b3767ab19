"""Precedence resolution across revision steps (J8), subsets (J6) and step counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = ("step1", "step2", "step3")


def first_per_key(df: DataFrame, key: str, pos_col: str, cols: Sequence[str]) -> DataFrame:
    """First row per key in file order (``min_by`` over the position column).

    A partial aggregate: a key repeated a billion times is reduced map-side first, never
    collected into one task."""
    packed = F.struct(*[F.col(c) for c in cols])
    return (
        df.groupBy(key)
        .agg(F.min_by(packed, F.col(pos_col)).alias("_first"))
        .select(key, *[F.col(f"_first.{c}").alias(c) for c in cols])
    )


def resolve_final(
    step1: DataFrame,
    step2: DataFrame | None,
    step3: DataFrame | None,
    key: str = "doc_id",
    pos_col: str = "_pos",
    keep: Sequence[str] = ("target_sent", "target_label_str"),
) -> DataFrame:
    """Manual fix (step 3), else the regenerated text if ``is_ok_step2 = 1``, else the
    initial text. A missing step file means "no rows at this step" (S8).

    Output: key, kept columns, ``final_sent``, ``source``."""
    out = step1.select(key, *keep, "augmented_sent")
    if step3 is not None:
        s3 = first_per_key(step3, key, pos_col, ["final_manual_sent"]).withColumn("_in3", F.lit(True))
        out = out.join(s3, key, "left")
    else:
        out = out.withColumns({"final_manual_sent": F.lit(None).cast("string"), "_in3": F.lit(None).cast("boolean")})
    if step2 is not None:
        s2 = first_per_key(step2, key, pos_col, ["augmented_sent_step2", "is_ok_step2"]).withColumn("_in2", F.lit(True))
        out = out.join(s2, key, "left")
    else:
        out = out.withColumns(
            {
                "augmented_sent_step2": F.lit(None).cast("string"),
                "is_ok_step2": F.lit(None).cast("int"),
                "_in2": F.lit(None).cast("boolean"),
            }
        )
    in3 = F.coalesce(F.col("_in3"), F.lit(False))
    ok2 = F.coalesce(F.col("_in2"), F.lit(False)) & F.coalesce(F.col("is_ok_step2") == 1, F.lit(False))
    return out.select(
        key,
        *keep,
        F.when(in3, F.col("final_manual_sent"))
        .when(ok2, F.col("augmented_sent_step2"))
        .otherwise(F.col("augmented_sent"))
        .alias("final_sent"),
        F.when(in3, F.lit("step3")).when(ok2, F.lit("step2")).otherwise(F.lit("step1")).alias("source"),
    )


def step_counts(resolved: DataFrame) -> DataFrame:
    """Total records and records per source step, one row (absent steps count 0)."""
    return resolved.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("source") == s).alias(s) for s in STEPS],
    )


def subset_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Keep rows whose key is in a filtered id list (left semi join)."""
    return df.join(ids.select(key), key, "left_semi")
