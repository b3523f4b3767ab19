"""Helpers shared by the operators of this subpackage.

``read`` loads a table, ``scratch``/``materialize`` write lineage cuts to the shared folder of
``spark.checkpoint.dir`` (unique folder per run), ``with_columns_clash_safe`` keeps extra input
columns out of the way.  Python functions that run in tasks are pickled by value, so executors
need no copy of this package.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelq.session import bounded, checkpoint_dir, free_memory, small_batches  # noqa: F401 - operators import them from here

cloudpickle.register_pickle_by_value(sys.modules["labelq"])

#: White space bytes that separate words: space and U+0009 to U+000D.
SPACE_CHARS = " \t\n\u000b\f\r"
#: Java regex of one run of them.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Spark setting that deletes shuffle files at the end of a query.
SHUFFLE_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder; two runs never share one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/labelq-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage ends there, so
    a lost executor costs a re-read, and several consumers share one evaluation."""
    path = scratch(df.sparkSession, name)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes in this block delete their shuffle files once they have ended (a setting of Spark 4.1; without it the files stay
    until the driver's garbage is collected): what was written is read from its table."""
    before = spark.conf.get(SHUFFLE_SETTING, None)
    spark.conf.set(SHUFFLE_SETTING, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_SETTING)
        else:
            spark.conf.set(SHUFFLE_SETTING, before)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more: what was made from them must be written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """Array of the maximal runs of non-space characters of ``text``; empty for null or blank."""
    t = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.length(t) > 0, F.split(t, SPACE_RUN, -1)).otherwise(F.array().cast("array<string>"))
