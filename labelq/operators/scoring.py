"""External models as one dataflow operator.

``batch_score`` runs a caller-supplied ``scorer(list[str]) -> list[dict]`` inside
``mapInPandas``: Spark partitions the rows, each task re-batches its Arrow batches into
calls of ``batch_size`` texts, carries the row keys through the call (no positional zip),
retries with back-off, halves a call that keeps failing until the rows at fault are alone, and
keeps failed rows with ``status = 'failed'``. Whether a row fails then depends on the row, not on
the rows that share its call. A pause between calls is a budget of the whole job: rows are dealt to a
stated number of tasks, each of which leaves that many pauses between its calls. Task
retries repeat calls, so outputs are keyed and the caller's sink should be an overwrite of the keyed
result; persist or write the result before it fans out to several sinks.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelq.session import bounded, ship_package, small_batches

BATCH_SIZE = 50  # rows per call (moderation pacing of the reference)
MAX_RETRIES = 5
PAUSE_S = 0.5
PACED_TASKS = 8  # tasks that share the pace of a job


class RateLimited(Exception):
    """Scorer signal: rate limit; wait 2**attempt + 1 seconds and retry."""


class ServiceError(Exception):
    """Scorer signal: transient service error; wait 5 seconds and retry."""


class Pacer:
    """Lets a task call at most once every ``interval`` seconds, the first time after ``offset``."""

    def __init__(self, interval: float, offset: float = 0.0, sleep: Callable[[float], None] = time.sleep,
                 clock: Callable[[], float] = time.monotonic):
        self.interval, self.sleep, self.clock = interval, sleep, clock
        self.free_at = clock() + offset

    def wait(self) -> None:
        if self.interval <= 0:
            return
        now = self.clock()
        if now < self.free_at:
            self.sleep(self.free_at - now)
        self.free_at = max(now, self.free_at) + self.interval


def call_with_retry(
    scorer: Callable[[list], list],
    batch: list,
    max_retries: int = MAX_RETRIES,
    sleep: Callable[[float], None] = time.sleep,
) -> tuple[list | None, int]:
    """M2: returns (results or None, attempts). Unknown errors give up at once."""
    for attempt in range(max_retries):
        try:
            return scorer(batch), attempt + 1
        except RateLimited:
            sleep(2**attempt + 1)
        except ServiceError:
            sleep(5)
        except Exception:  # noqa: BLE001 - unknown error: give up on this batch
            return None, attempt + 1
    return None, max_retries


def call_by_halves(
    scorer: Callable[[list], list],
    batch: list,
    max_retries: int = MAX_RETRIES,
    sleep: Callable[[float], None] = time.sleep,
) -> tuple[list, list[int]]:
    """M3: (result or None, attempts of its last call) of every row of ``batch``.

    A call that fails after its retries, or returns another number of results, is cut in half and each half is called once, and so on
    down to single rows, which have all retries again. One bad row among n costs at most 2 * max_retries + 2 * log2(n) calls, n
    bad rows at most n * (max_retries + 2)."""
    return _halved(scorer, batch, max_retries, max_retries, sleep)


def _halved(scorer, batch: list, tries: int, max_retries: int, sleep: Callable[[float], None]) -> tuple[list, list[int]]:
    results, attempts = call_with_retry(scorer, batch, tries, sleep)
    if results is not None and len(results) == len(batch):
        return list(results), [attempts] * len(batch)
    if len(batch) <= 1:
        return [None] * len(batch), [attempts] * len(batch)
    half = len(batch) // 2
    left, right = (_halved(scorer, part, max_retries if len(part) == 1 else 1, max_retries, sleep) for part in (batch[:half], batch[half:]))
    return left[0] + right[0], left[1] + right[1]


def batch_score(
    df: DataFrame,
    text_col: str,
    key_cols: Sequence[str],
    scorer: Callable[[list], list],
    result_fields: Sequence[T.StructField],
    batch_size: int = BATCH_SIZE,
    max_retries: int = MAX_RETRIES,
    pause_s: float = PAUSE_S,
    sleep: Callable[[float], None] = time.sleep,
    keep_text: bool = False,
    paced_tasks: int = PACED_TASKS,
    skip: str | None = None,
) -> DataFrame:
    """M1-M3: score ``text_col`` in calls of ``batch_size`` rows.

    Output: ``key_cols`` + ``result_fields`` + ``status`` ('ok' / 'failed' / 'skipped') + ``attempts`` (of the row's last call).
    Only the key and text columns cross into Python (select before the operator);
    ``keep_text`` returns the text too, so callers need no join back to the input. Rows whose boolean column ``skip`` is true
    pass through the task without a call (their texts need not be sent: make them NULL).

    ``pause_s`` is the least time between two calls of the whole job, retries and halves included. With a pause the rows are dealt by
    key to ``paced_tasks`` tasks, and each waits ``paced_tasks * pause_s`` between its calls, staggered at the start. The rate
    holds however many of them run at a time, and is used up when all do; ``pause_s=0`` leaves the rows where they are.
    """
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)
    keys = list(key_cols)
    src = df.select(*keys, text_col, *([F.coalesce(F.col(skip), F.lit(False)).alias("_skip")] if skip else []))
    if pause_s > 0:
        src = src.repartition(paced_tasks, *keys)
    if keep_text:
        keys = keys + [text_col]
    key_fields = [src.schema[k] for k in keys]
    out_schema = T.StructType(
        key_fields
        + list(result_fields)
        + [T.StructField("status", T.StringType()), T.StructField("attempts", T.IntegerType())]
    )
    names = [f.name for f in result_fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        pacer = Pacer(pause_s * paced_tasks, pause_s * (context.partitionId() if context else 0))
        pending: list[pd.DataFrame] = []
        size = 0

        def paced(texts: list) -> list:
            pacer.wait()
            return scorer(texts)

        def result(chunk: pd.DataFrame, results: list, status: list[str], attempts: list[int]) -> pd.DataFrame:
            out = chunk[keys].reset_index(drop=True)
            rows = pd.DataFrame.from_records([r if r is not None else {} for r in results], columns=names).astype(object)
            for n in names:
                out[n] = rows[n].where(rows[n].notna(), None)
            out["status"], out["attempts"] = status, attempts
            return out

        def flush(chunk: pd.DataFrame) -> pd.DataFrame:
            results, attempts = call_by_halves(paced, chunk[text_col].tolist(), max_retries, sleep)
            return result(chunk, results, ["failed" if r is None else "ok" for r in results], attempts)

        for pdf in batches:
            if skip:
                passed = pdf[pdf["_skip"]]
                if len(passed):
                    yield result(passed, [None] * len(passed), ["skipped"] * len(passed), [0] * len(passed))
                pdf = pdf[~pdf["_skip"]]
            if not len(pdf):
                continue
            pending.append(pdf)
            size += len(pdf)
            while size >= batch_size:
                # One concatenation per incoming batch; calls are slices of it.
                buf = pd.concat(pending, ignore_index=True)
                whole = size - size % batch_size
                for lo in range(0, whole, batch_size):
                    yield flush(buf.iloc[lo:lo + batch_size])
                rest = buf.iloc[whole:]
                pending, size = ([rest] if len(rest) else []), len(rest)
        if size:
            yield flush(pd.concat(pending, ignore_index=True))

    return src.mapInPandas(bounded(run), out_schema)


def gated_predict(
    df: DataFrame,
    gate: Column,
    scored: Callable[[DataFrame], DataFrame],
    constants: dict[str, Column],
) -> DataFrame:
    """M5 + P19: rows passing the gate get constants and never reach the model; the rest are
    scored by ``scored``, any function of rows. The gate filter is applied before the scorer (Catalyst keeps
    filters above MapInPandas, so the order is explicit). The input is read twice: see :func:`gated_scoring`."""
    gated = df.where(gate).withColumns(constants)
    rest = scored(df.where(~gate))
    return rest.unionByName(gated, allowMissingColumns=True)


def gated_scoring(
    df: DataFrame,
    gate: Column,
    text: Column,
    key_cols: Sequence[str],
    scorer: Callable[[list], list],
    result_fields: Sequence[T.StructField],
    predict: dict[str, Column],
    constants: dict[str, Column],
    drop_gated: bool = False,
    phase_col: str = "phase",
    phases: tuple[str, str] = ("gated", "scored"),
    **options,
) -> DataFrame:
    """M5 + P19 in one scan: rows with ``gate`` get ``constants`` and never reach the model; for the others ``text`` is scored and
    ``predict`` turns the ``result_fields`` into the same columns. Gated rows pass through the scorer's task without
    their text (it is NULL on that side), or are left out before it with ``drop_gated``.

    Output: ``key_cols``, the columns of ``predict``, ``phase`` (which of the two it was) and ``status``. A NULL gate is no gate."""
    if predict.keys() != constants.keys():
        raise ValueError(f"constants {sorted(constants)} and predictions {sorted(predict)} differ")
    closed = F.coalesce(gate, F.lit(False))
    src = df.where(~closed) if drop_gated else df
    src = src.withColumns({"_gated": closed, "_text": F.when(~closed, text)})
    scored = batch_score(src, "_text", [*key_cols, "_gated"], scorer, result_fields, skip="_gated", **options)
    return scored.select(
        *key_cols,
        *[F.when(F.col("_gated"), constants[c]).otherwise(predict[c]).alias(c) for c in predict],
        F.when(F.col("_gated"), F.lit(phases[0])).otherwise(F.lit(phases[1])).alias(phase_col),
        "status",
    )
