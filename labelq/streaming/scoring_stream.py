"""The row-local operators on a streaming DataFrame.

The reference has no streaming logic (no watermark, window or state); every input is a
finished file. Its parsers, normalisers and the batch scorer are stateless per row, so they
apply unchanged to a ``readStream`` source. This module wires them to a file stream with an
exactly-once file sink: the checkpoint location records which input files were committed,
so a restarted or partly failed query neither loses nor repeats a micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from labelq.functions import parsers as P
from labelq.operators.scoring import batch_score


def parse_responses(df: DataFrame, response_col: str = "response") -> DataFrame:
    """F1-F6 on a (streaming or batch) frame of model responses."""
    r = F.col(response_col)
    yn = P.parse_yes_no(r)
    return df.withColumns(
        {
            "predicted_label": P.parse_label(r),
            "pred_is_ambiguous": P.parse_verdict(r),
            "pred_bracket": P.parse_bracket(r),
            "pred_stepwise": P.parse_stepwise(r),
            "predicted_score": P.parse_score(r),
            "decision": yn["decision"],
            "added_info": yn["text"],
        }
    )


def start_scoring_stream(
    spark: SparkSession,
    source_dir: str,
    schema: T.StructType,
    text_col: str,
    key_cols: Sequence[str],
    scorer: Callable[[list], list],
    result_fields: Sequence[T.StructField],
    out_dir: str,
    checkpoint: str,
    glob: str = "*.parquet",
    available_now: bool = True,
) -> StreamingQuery:
    """M1 on new files of ``source_dir``: score each micro-batch, append keyed results to
    ``out_dir`` (Parquet file sink, exactly once through ``checkpoint``)."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(source_dir)
    scored = batch_score(stream, text_col, key_cols, scorer, result_fields, pause_s=0.0)
    writer = scored.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start(out_dir)
