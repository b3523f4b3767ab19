"""Result-tree discovery (S6): ``<root>/<model>/<method>/<prompt>/<file>.csv``.

The tree is listed once; (model, method, prompt) arguments prune files before any is opened, the result file is chosen by method,
and columns are bound by header, since every method writes a layout of its own.  Folders may be plain names or ``level=value``
as Spark writes them; a result file may be a folder of part files.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelq.sources.by_header import Field, fields_of, list_files, read_files
from labelq.sources.io import CSV_READ

# The result file name per method.
RESULT_FILE = {
    "classification": "results.csv",
    "scoring": "scoring_results.csv",
    "stepwise": "stepwise_results.csv",
    "fewshot": "fewshot_results.csv",
    "categorical": "categorical_results.csv",
}
LEVELS = ("model", "method", "prompt")


def _plain(path: str) -> str:
    """A listed path without its scheme and authority."""
    return re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?(?=/)", "", path)


def _level(name: str) -> str:
    """The value of a folder name: of ``level=value`` the value, without the escapes of Spark's writer."""
    key, sep, value = name.partition("=")
    return unquote(value) if sep and key in LEVELS else name


def choose_files(files: Sequence[str], root: str, **wanted: Sequence[str] | None) -> list[str]:
    """The result files among ``files`` (listed below ``root``) with the wanted model, method and prompt values."""
    base = _plain(root).rstrip("/") + "/"
    out = []
    for f in files:
        path = _plain(f)
        parts = path[path.index(base) + len(base):].split("/") if base in path else []
        if len(parts) < 4 or any(p.startswith((".", "_")) for p in parts[3:]):
            continue
        values = dict(zip(LEVELS, map(_level, parts)))
        if any(wanted.get(k) and v not in wanted[k] for k, v in values.items()):
            continue
        # Plain trees name the file by method; a tree of Spark's writer has part files in the last folder.
        if parts[3] == RESULT_FILE.get(values["method"]) or (parts[2].startswith("prompt=") and len(parts) == 4):
            out.append(f)
    return out


def _levels_of(file_path: Column, root: str) -> list[Column]:
    # The metadata path is percent-encoded once; ``+`` stands for itself there.
    path = F.url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B")))
    base = _plain(root).rstrip("/") + "/"
    parts = F.split(F.element_at(F.split(path, rf"\Q{base}\E", 2), 2), "/")
    out = []
    for i, level in enumerate(LEVELS):
        name = parts.getItem(i)
        value = F.substring(name, len(level) + 2, 1 << 30)
        out.append(F.when(F.startswith(name, F.lit(f"{level}=")), F.url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))).otherwise(name).alias(level))
    return out


def read_result_tree(
    spark: SparkSession,
    root: str,
    schema: T.StructType | Sequence[Field],
    models: list[str] | None = None,
    methods: list[str] | None = None,
    prompts: list[str] | None = None,
) -> DataFrame:
    """Rows of all chosen result files with the declared fields, ``_bad`` and model, method, prompt.  A file without a required column is
    an error; a tree without a chosen file has no rows."""
    files = choose_files(list_files(spark, root), root, model=models, method=methods, prompt=prompts)
    fields = fields_of(schema)
    rows = read_files(spark, dict.fromkeys(files, 0), fields).rows
    if rows is None:
        ddl = [f"`{f.name}` {f.type}" for f in fields] + ["_bad array<struct<column:string,value:string>>", *[f"{x} string" for x in LEVELS]]
        return spark.createDataFrame([], ", ".join(ddl))
    return rows.select(*[f.name for f in fields], "_bad", *_levels_of(F.col("_file"), root))


def read_partitioned_results(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    models: list[str] | None = None,
    methods: list[str] | None = None,
    prompts: list[str] | None = None,
) -> DataFrame:
    """S6 over a Spark-written tree ``model=/method=/prompt=`` of one layout: native partition discovery,
    and the arguments become partition filters (only matching folders are listed and read)."""
    part_schema = T.StructType(
        list(schema.fields) + [T.StructField(c, T.StringType()) for c in ("model", "method", "prompt")]
    )
    df = spark.read.options(**CSV_READ).schema(part_schema).csv(root)
    for col, values in (("model", models), ("method", methods), ("prompt", prompts)):
        if values:
            df = df.where(F.col(col).isin(*values))
    return df
