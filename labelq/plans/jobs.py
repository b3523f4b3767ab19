"""End-to-end jobs that write files: the reference's stage outputs as Spark sinks.

- ``moderation_split``: M1 scoring -> keyed result materialised once -> quadrant split sink
  (K6, one pass with ``partitionBy('quadrant')`` instead of four filtered writes).
- ``reevaluation_outputs``: per-run metrics partitioned by gt_type / model / method / prompt
  (K5) and one text report per run (K4).
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelq.operators import metrics as M
from labelq.operators.scoring import batch_score
from labelq.session import materialize
from labelq.sources.io import report_column, write_csv, write_text


def moderation_split(
    items: DataFrame,
    scorer: Callable[[list], list],
    out_dir: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "label",
    flag_field: str = "moderation_flagged",
    extra_fields: Sequence[T.StructField] = (),
    name: str = "moderation",
) -> DataFrame:
    """Score items once, keep the keyed result, write it whole and split by quadrant."""
    fields = [T.StructField(flag_field, T.BooleanType()), *extra_fields]
    scored = batch_score(items.select(id_col, label_col, text_col), text_col, [id_col, label_col], scorer, fields)
    q = M.quadrant(F.col(label_col), F.col(flag_field))
    result = materialize(
        scored.withColumns(
            {
                "quadrant": q,
                "is_ambiguous_candidate": F.coalesce(q == "A", F.lit(False)),
                "is_contextual_safety": F.coalesce(q == "B", F.lit(False)),
            }
        ),
        name,
    )
    write_csv(result, os.path.join(out_dir, "full_results"))
    write_csv(result.where(F.col("quadrant").isNotNull()), os.path.join(out_dir, "quadrants"), partition_by=["quadrant"])
    return result


def reevaluation_outputs(metrics: DataFrame, out_dir: str) -> None:
    """K5 + K4 for a metrics table with gt_type, model, method, prompt and A9/A10 columns."""
    keys = ["gt_type", "model", "method", "prompt"]
    write_csv(metrics, os.path.join(out_dir, "metrics"), partition_by=keys)
    title = F.concat_ws(" / ", *[F.col(k) for k in keys])
    fields = [("Samples", "n"), ("TP", "tp"), ("FN", "fn"), ("FP", "fp"), ("TN", "tn"),
              ("Accuracy", "accuracy"), ("Precision", "precision"), ("Recall", "recall"), ("F1", "f1")]
    write_text(metrics.select(report_column(metrics, title, fields).alias("report")), os.path.join(out_dir, "reports"))
