"""Session helpers.

On a cluster the session is created by the caller and ``spark.checkpoint.dir`` names a
shared folder; we only read it. Tests and the bench create a local session and, only when
the setting is absent, point it at a fresh scratch folder.
"""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import SparkSession

#: Spark setting that ends an Arrow batch by its bytes, and the limit used where the session has none.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "2m"


def build_session(
    master: str = "local[*]",
    shuffle_partitions: int = 8,
    app_name: str = "labelq",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and derived files: ``spark.checkpoint.dir`` or the folder given to
    ``setCheckpointDir``. Only a local-mode session without either (tests, the bench) gets a fresh
    folder of this machine; on a cluster an unset folder is an error."""
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = "file://" + tempfile.mkdtemp(prefix="labelq-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A new path under the shared checkpoint folder; no two calls share one."""
    return "/".join([checkpoint_dir(spark).rstrip("/"), f"labelq-{uuid.uuid4().hex}", *parts])


def ship_package(spark: SparkSession) -> None:
    """Send ``labelq`` functions to Python workers by value, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules["labelq"])


def small_batches(spark: SparkSession) -> None:
    """Let Spark end an Arrow batch at BATCH_BYTES, unless the session has a limit of its own: rows of whole
    texts make batches of very uneven size, and each exists several times in an executor."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def free_memory() -> None:
    """Give memory that this Python process has freed back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def bounded(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow`` or ``mapInPandas``; at its end the Python worker, which lives on, gives free memory back."""
    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        free_memory()

    return task


def materialize(df, name: str):
    """Cut lineage by writing ``df`` as Parquet under the shared checkpoint folder and reading
    it back. Use before a result fans out to several sinks (scorer output must not be
    recomputed per sink) and on long plans, so a lost executor costs a re-read, not a
    re-run of the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, "materialized", name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
