"""CSV scans that bind columns by header name.

Files of one dataset may differ in column order, in optional columns and in stale extra columns, so a positional
schema would mix them up.  ``read_by_header`` looks at the first line of every file, groups the files by header, reads
each group once with Spark's CSV reader under an all-text schema, binds the declared fields by name (or alias) and unions
the groups by name.  A group is one scan whatever its number of files, so the plan grows with the number of layouts.

Types are applied afterwards: a value that does not parse is NULL and listed in ``_bad`` with its text, and a row with more values
than the header is listed there whole, so nothing is lost in silence.
"""

from __future__ import annotations

import csv
import warnings
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelq.functions.text import py_strip

BOM = "﻿"
CSV_TEXT = {"header": "true", "multiLine": "true", "escape": '"', "nullValue": "", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
#: Texts that stand for a missing value in a column that is not text.
MISSING = ("", "nan", "null", "none", "na", "n/a", "<na>")
#: Headers read at the same time.
READERS = 8
#: Lines that a header with line breaks inside quotes may take.
HEADER_LINES = 64

_BAD = "array<struct<column:string,value:string>>"


@dataclass(frozen=True)
class Field:
    """A declared column: its type (DDL), whether every file must have it, and other names it goes by."""

    name: str
    type: str = "string"
    required: bool = True
    aliases: tuple[str, ...] = ()


@dataclass
class Scan:
    """``rows`` of the files that were read (None when there is none), and path -> reason of those that were not."""

    rows: DataFrame | None
    skipped: dict[str, str] = field(default_factory=dict)


def fields_of(schema: T.StructType | Sequence[Field]) -> list[Field]:
    """Fields of a Spark schema; nullable columns stay required, as a positional schema would have them."""
    return [f if isinstance(f, Field) else Field(f.name, f.dataType.simpleString()) for f in schema]


def list_files(spark: SparkSession, path: str, glob: str = "*.csv") -> list[str]:
    """Every file below ``path`` (a file, folder or glob), in path order.  Spark lists folders in parallel; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return sorted(r[0] for r in found.select("path").toLocalIterator())


def first_record(lines: Iterable[str]) -> list[str] | None:
    """Values of the first CSV record of ``lines``; None when there is none, ValueError when it never ends."""
    held = ""
    for line in lines:
        held += line.rstrip("\r") + "\n"
        if held.count('"') % 2 == 0:
            return next(csv.reader([held.rstrip("\n").removeprefix(BOM)]), None)
    if held:
        raise ValueError("the header has a quote that is not closed")
    return None


def read_header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names of one file: of a text scan that ends after its first lines."""
    lines = spark.read.option("lineSep", "\n").text(path)
    held = [r[0] for r in lines.head(1)]
    if held and held[0].count('"') % 2:  # a line break inside quotes
        held = [r[0] for r in lines.head(HEADER_LINES)]
    names = first_record(held)
    if not names:
        raise ValueError("no header")
    return tuple(n.strip() for n in names)


def read_headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, tuple[str, ...] | Exception]:
    """Header of each file, or why it has none."""
    def one(path: str) -> tuple[str, ...] | Exception:
        try:
            return read_header(spark, path)
        except (PySparkException, Py4JJavaError, ValueError, csv.Error) as why:
            return why

    with ThreadPoolExecutor(READERS) as pool:
        return dict(zip(paths, pool.map(one, paths)))


def bind(fields: Sequence[Field], header: Sequence[str]) -> dict[str, int | None]:
    """Position of every field in ``header``: of its name, else of its first alias there, else None; of a repeated name the first."""
    at = {}
    for i, name in enumerate(header):
        at.setdefault(name, i)
    return {f.name: next((at[n] for n in (f.name, *f.aliases) if n in at), None) for f in fields}


def missing_required(fields: Sequence[Field], header: Sequence[str]) -> list[str]:
    places = bind(fields, header)
    return [f.name for f in fields if f.required and places[f.name] is None]


def parse_as(text: Column, ddl: str) -> Column:
    """``text`` as a value of type ``ddl``: NULL where it is none.  Whole numbers may be written as 3.0, booleans in any case or as 1 / 0."""
    kind = ddl.lower()
    if kind == "string":
        return text
    t = F.lower(py_strip(text))
    if kind == "boolean":
        return F.when(t.isin("true", "1", "1.0"), F.lit(True)).when(t.isin("false", "0", "0.0"), F.lit(False))
    if kind in ("tinyint", "smallint", "int", "integer", "bigint", "long"):
        number = t.try_cast("decimal(38,10)")
        return F.when(number == F.floor(number), number.try_cast("decimal(38,0)").try_cast(kind))
    return t.try_cast(kind)


def _typed(raw: DataFrame, fields: Sequence[Field], places: dict[str, int | None], carried: Sequence[Column]) -> DataFrame:
    values, bad = [], []
    for f in fields:
        i = places[f.name]
        if i is None:
            values.append(F.lit(None).cast(f.type).alias(f.name))
            continue
        text = F.col(f"c{i}")
        value = parse_as(text, f.type)
        values.append(value.alias(f.name))
        if f.type.lower() != "string":
            wrong = text.isNotNull() & value.isNull() & ~F.lower(py_strip(text)).isin(*MISSING)
            bad.append(F.when(wrong, F.struct(F.lit(f.name).alias("column"), text.alias("value"))))
    if "_corrupt" in raw.columns:
        bad.append(F.when(F.col("_corrupt").isNotNull(), F.struct(F.lit("*").alias("column"), F.col("_corrupt").alias("value"))))
    listed = F.filter(F.array(*bad), lambda b: b.isNotNull()) if bad else F.array()
    return raw.select(*values, *carried, listed.cast(_BAD).alias("_bad"))


def read_files(spark: SparkSession, files: dict[str, int], fields: Sequence[Field], skipped: dict[str, str] | None = None,
               on_unreadable: str = "error") -> Scan:
    """``read_by_header`` over listed files, each with the number of its part."""
    skipped = dict(skipped or {})
    groups: dict[tuple[tuple[str, ...], int], list[str]] = {}
    for path, header in read_headers(spark, list(files)).items():
        if isinstance(header, Exception):
            skipped[path] = f"unreadable: {str(header).splitlines()[0]}"
        elif lacking := missing_required(fields, header):
            skipped[path] = f"required columns missing: {', '.join(lacking)}"
        else:
            groups.setdefault((header, files[path]), []).append(path)
    if skipped and on_unreadable != "skip":
        raise ValueError("; ".join(f"{p}: {why}" for p, why in sorted(skipped.items())))
    for path, why in sorted(skipped.items()):
        warnings.warn(f"{path} skipped: {why}", stacklevel=3)
    scans = []
    for (header, part), members in groups.items():
        raw_schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))] + [T.StructField("_corrupt", T.StringType())])
        raw = spark.read.options(**CSV_TEXT).schema(raw_schema).csv(members)
        scans.append(_typed(raw, fields, bind(fields, header), [F.col("_metadata.file_path").alias("_file"), F.lit(part).alias("_part")]))
    return Scan(reduce(DataFrame.unionByName, scans) if scans else None, skipped)


def read_by_header(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | Sequence[Field], on_unreadable: str = "error") -> Scan:
    """Rows of all files of ``paths`` (files, folders or globs) with the declared fields, ``_file`` (path), ``_part`` (position of the given path)
    and ``_bad`` (array of column, value).

    A path without a file, or a file without a header or without a required column, is an error (ValueError naming them all) or, with
    ``on_unreadable="skip"``, left out with a warning and listed in ``skipped``."""
    files: dict[str, int] = {}
    skipped: dict[str, str] = {}
    for part, path in enumerate([paths] if isinstance(paths, str) else paths):
        try:
            found = list_files(spark, path, "*")
        except (PySparkException, Py4JJavaError) as why:
            skipped[path] = f"not found or not listed ({type(why).__name__})"
            continue
        if not found:
            skipped[path] = "no file"
        for f in found:
            files.setdefault(f, part)
    return read_files(spark, files, fields_of(schema), skipped, on_unreadable)
