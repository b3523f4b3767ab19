"""Readers (S1, S2, S4, S5, S7, S8) and writers (K1-K9).

CSV is the edge format of the reference; inside the engine tables are Parquet. CSV reads
always carry a declared schema and ``multiLine`` + ``escape='"'`` (model responses hold
newlines and doubled quotes). A UTF-8 BOM is stripped by Spark's reader in both line modes.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelq.functions.text import py_strip
from labelq.sources.by_header import read_by_header

BOM = "﻿"

CSV_READ = {"header": "true", "multiLine": "true", "escape": '"', "nullValue": "", "mode": "PERMISSIVE"}
# Spark's writer trims values unless told not to.
CSV_WRITE = {"header": "true", "escape": '"', "quoteAll": "false", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """CSV with header and declared schema; BOM-aware."""
    return spark.read.options(**CSV_READ).schema(schema).csv(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def read_many(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str, fmt: str = "csv", tag_col: str | None = None) -> DataFrame | None:
    """S2 + U1: the union by name of the files that exist and can be read (others are skipped with a warning), optionally tagging each
    row with the position of its path.  CSV columns are bound by header; None when no file is left."""
    if fmt == "csv":
        fields = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema
        rows = read_by_header(spark, paths, fields, on_unreadable="skip").rows
        if rows is None:
            return None
        return rows.select(*fields.names, *([F.col("_part").alias(tag_col)] if tag_col else []))
    parts = []
    for i, p in enumerate(paths):
        try:
            df = spark.read.schema(schema).format(fmt).load(p)
        except AnalysisException as why:
            warnings.warn(f"{p} skipped: {why.getCondition() or why}", stacklevel=2)
            continue
        parts.append(df.withColumn(tag_col, F.lit(i)) if tag_col else df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """An absent file means "no rows at this step": an empty frame of the schema."""
    if _exists(spark, path):
        return read_csv(spark, path, schema)
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    return spark.createDataFrame([], st)


def read_templates(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Whole-file text source: one row (path, name, template) per file, white space at both ends removed."""
    df = spark.read.text(paths, wholetext=True)
    path = F.col("_metadata.file_path")
    return df.select(
        path.alias("path"),
        F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1).alias("name"),
        py_strip(F.col("value")).alias("template"),
    )


def clustered(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``df`` dealt by ``cols`` so that a writer opens few files per value: AQE splits a value that is too large for a task and joins
    small ones."""
    return df.hint("rebalance", *cols)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """K1 / K5 / K6 / K7 / K9: CSV sink; ``partition_by`` writes one folder per value
    (confusion cell, quadrant, target slot, category, or gt_type/model/method/prompt), rows
    clustered by it. Spark's committer publishes the files when the whole job has succeeded."""
    if partition_by:
        clustered(df, partition_by).write.mode(mode).options(**CSV_WRITE).partitionBy(*partition_by).csv(path)
    else:
        df.write.mode(mode).options(**CSV_WRITE).csv(path)


def write_ordered(df: DataFrame, path: str, order_cols: Sequence[str], fmt: str = "csv", mode: str = "overwrite", files: int | None = None) -> None:
    """A sink whose files, read in the order of their names, hold the rows in the order of ``order_cols`` (NULLs first).

    Rows are dealt into sampled ranges of the whole key and sorted inside each; Spark numbers the part files by range. No
    step sorts everything in one task. Give a key that tells rows apart, or a hot key value is one range."""
    cols = [F.col(c) for c in order_cols]
    ranged = df.repartitionByRange(files, *cols) if files else df.repartitionByRange(*cols)
    w = ranged.sortWithinPartitions(*cols).write.mode(mode)
    (w.options(**CSV_WRITE) if fmt == "csv" else w).format(fmt).save(path)


def read_in_order(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a Parquet folder of :func:`write_ordered` with ``_file`` (name) and ``_row`` (position in the file): sorted by both they are in
    the order written."""
    df = spark.read.parquet(path)
    return df.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def with_bom_header(df: DataFrame) -> DataFrame:
    """K2: prefix the first column name with U+FEFF so spreadsheets detect UTF-8."""
    first = df.columns[0]
    return df.withColumnRenamed(first, BOM + first)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K3: JSON lines sink (metrics rows; vocabulary pools)."""
    df.write.mode(mode).json(path)


def pools_json(pools: DataFrame) -> DataFrame:
    """K3 for vocabulary pools: one JSON object {category: [terms]} (bounded by the rules)."""
    return pools.agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "terms"))))).alias("json")
    )


def report_column(df: DataFrame, title: Column, fields: Sequence[tuple[str, str]]) -> Column:
    """K4: report text of one row: a title, a rule, then ``label : value`` lines (doubles
    with 4 decimals, other values as text, NULL as ``nan``)."""
    lines: list[Column] = [title, F.lit("-" * 40)]
    for label, c in fields:
        dt = df.schema[c].dataType
        val = F.format_number(F.col(c), 4) if isinstance(dt, (T.DoubleType, T.FloatType)) else F.col(c).cast("string")
        lines.append(F.concat(F.lit(f" {label:<24}: "), F.coalesce(val, F.lit("nan"))))
    return F.concat_ws("\n", *lines)


def sections(df: DataFrame, run: Sequence[str], order: int, lines: Sequence[Column | str]) -> DataFrame:
    """K4: one section per row of ``df``: the run's keys, where it stands in the report, and its lines as text."""
    parts = [F.lit(x) if isinstance(x, str) else x for x in lines]
    return df.select(*run, F.lit(order).alias("ord"), F.concat_ws("\n", *parts).alias("text"))


def figure(label: str, value: Column, digits: int | None = None) -> Column:
    """K4: ``label : value``; numbers with ``digits`` decimals, NULL as nan."""
    text = F.format_number(value, digits) if digits is not None else value.cast("string")
    return F.concat(F.lit(f" {label:<24}: "), F.coalesce(text, F.lit("nan")))


def assemble(parts: DataFrame, run: Sequence[str]) -> DataFrame:
    """K4: one report per run of its sections (keys, ord, text), in order, blank lines between; a run has a handful of them."""
    held = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return parts.groupBy(*run).agg(F.array_join(F.transform(held, lambda s: s["text"]), "\n\n").alias("report"))


def write_text(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K4 / K8: text sink of a one-column frame (reports, assembled prompts)."""
    df.write.mode(mode).text(path)
