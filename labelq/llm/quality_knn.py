"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

Texts become counts of byte-class pairs (lower-case letters one by one, capitals, digits, spaces,
line breaks, each ASCII mark, high bytes) and of repeated adjacent words.  Relative counts are
weighted by the inverse document frequency over all documents and projected on the leading right singular
vectors of the labelled sample (latent semantic analysis, fitted by subspace iteration).  The labelled
vectors are broadcast; each document's cosines to all of them are exact blocked products, and
the NEIGHBOURS best vote with their label, weighted by cosine.

Bounded parameters: at most MAX_LABELLED labelled texts (by a hash of doc_id) of DIMENSIONS numbers, so
the broadcast is at most about MAX_LABELLED * DIMENSIONS * 4 bytes plus the projection.  Frequencies cover all
documents; every text is scored, whole.

Defined results: null and empty texts have no vector and get the labelled sample's mean label, as does everything
without labels (0.5 when none is known); equal cosines are taken in sample order; repeated rows get equal
scores; null labels are no evidence; a null doc_id is scored; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelq.llm.bytesops import PIECE, WordHasher, byte_values, slices, text_bytes
from labelq.llm.common import bounded, free_memory, read, small_batches
from labelq.llm.toxicity_pu import held_out

MAX_LABELLED = 4096
DIMENSIONS = 48
NEIGHBOURS = 15
BLOCK = 128
CLASSES = 64
#: Pair counts, then the count of words equal to the word before.
FEATURES = CLASSES * CLASSES + 1
REPEAT_WEIGHT = 4.0


def _classes() -> np.ndarray:
    out = np.full(256, 63, np.int64)  # high bytes
    out[97:123] = np.arange(26)
    out[65:91] = 26
    out[48:58] = 27
    out[[9, 11, 12, 13, 32]] = 28
    out[10] = 29
    out[:9] = out[14:32] = out[127] = 30
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    out[marks] = 31 + np.arange(len(marks)) % 32
    return out


class Counter:
    """Weighted feature rows of texts."""

    def __init__(self):
        self.classes = _classes()
        self.hasher = WordHasher(byte_values("words"))

    def __call__(self, column: pa.Array) -> np.ndarray:
        """Relative, damped counts: a float32 row of FEATURES per text."""
        raw, offsets = text_bytes(column)
        n = len(offsets) - 1
        counts = np.zeros((n, FEATURES), np.float32)
        lo, end = int(offsets[0]), int(offsets[-1])
        while lo < end - 1:
            hi = min(lo + PIECE, end - 1)  # pairs that begin in [lo, hi)
            c = self.classes[raw[lo:hi + 1]]
            doc = np.searchsorted(offsets, np.array([lo, hi]), "right") - 1
            first, last = int(doc[0]), min(int(doc[1]), n - 1)
            lengths = np.diff(np.clip(offsets[first:last + 2], lo, hi))
            owner = np.repeat(np.arange(last - first + 1), lengths)
            pair = owner * (CLASSES * CLASSES) + c[:-1] * CLASSES + c[1:]
            # A pair that spans two texts begins at the last byte of one.
            ends = offsets[first + 1:last + 1] - 1
            ends = ends[(ends >= lo) & (ends < hi)] - lo
            dropped = np.ones(hi - lo, bool)
            dropped[ends] = False
            got = np.bincount(pair[dropped], minlength=(last - first + 1) * CLASSES * CLASSES)
            counts[first:last + 1, :-1] += got.reshape(last - first + 1, -1)
            lo = hi
        words, at = self.hasher(raw, offsets)
        same = np.zeros(len(words) + 1)
        if len(words) > 1:
            same[2:] = np.cumsum(words[1:] == words[:-1])
            heads = np.unique(at[:-1][(at[:-1] > 0) & (at[:-1] < len(words))])
            joins = np.zeros(len(words) + 1)
            joins[heads + 1] = words[heads] == words[heads - 1]  # equal neighbours of two texts
            same -= np.cumsum(joins)
        repeats = same[at[1:]] - same[at[:-1]]
        total = np.maximum(counts.sum(1, keepdims=True), 1)
        counts *= 1000 / total
        counts[:, -1] = REPEAT_WEIGHT * repeats * 1000 / np.maximum(at[1:] - at[:-1], 1)
        return np.log1p(counts, out=counts)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """(rows, rows with each feature) over all of ``docs``; one row of FEATURES per task is summed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, n = Counter(), np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for lo, hi in slices(batch.num_rows, BLOCK):
                total += (count(batch.column(0).slice(lo, hi - lo)) > 0).sum(0)
                n += hi - lo
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], n))], names=["feature", "df"])

    sums = docs.select("text").mapInArrow(bounded(run), "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df"))
    got = dict(map(tuple, sums.collect()))  # at most FEATURES + 1 rows
    df = np.zeros(FEATURES)
    n = got.pop(-1, 0)
    for k, v in got.items():
        df[k] = v
    return n, df


@dataclass
class Model:
    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def project(rows: np.ndarray, idf: np.ndarray, projection: np.ndarray) -> np.ndarray:
    v = (rows * idf) @ projection
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return (v / np.where(norm > 0, norm, 1)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Model of the labelled rows of ``labels`` (doc_id, ``label`` 0 or 1) and the statistics of all of ``docs``."""
    small_batches(docs.sparkSession)
    n, df = document_frequencies(docs)
    idf = (np.log((n + 1) / (df + 1)) + 0.05).astype(np.float32)
    known = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter()
        for batch in batches:
            for lo, hi in slices(batch.num_rows, BLOCK):
                part = batch.slice(lo, hi - lo)
                rows = count(part.column(2)).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in rows], pa.binary())],
                                                 names=["doc_id", "y", "row"])

    sample = docs.join(F.broadcast(known), "doc_id").select("doc_id", F.col("y").cast("int").alias("y"), "text")
    got = sample.mapInArrow(bounded(run), "doc_id long, y int, row binary").orderBy("doc_id", "row").limit(2 * MAX_LABELLED).toArrow()
    y = got["y"].to_numpy().astype(np.float32)
    if not len(y):
        return Model(idf, np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    # Row by row into one array: the driver holds the sample twice at most, packed and as numbers.
    x = np.empty((len(y), FEATURES), np.float32)
    for i, b in enumerate(got["row"]):
        np.multiply(np.frombuffer(b.as_buffer(), np.float16), idf, out=x[i])
    del got, b
    free_memory()
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    q = np.random.default_rng(7).standard_normal((FEATURES, min(DIMENSIONS, len(y)))).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    q = np.ascontiguousarray(q)
    v = x @ q
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    del x
    free_memory()
    return Model(idf, q, v.astype(np.float32), y, float(y.mean()))


def vote(v: np.ndarray, model: Model, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Mean label of the nearest vectors of each row of ``v``, weighted by cosine; the prior for zero rows."""
    k = min(neighbours, len(model.labels))
    if not k:
        return np.full(len(v), model.prior)
    cos = v @ model.vectors.T
    best = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cos, best, 1).astype(np.float64), 0)
    total = weight.sum(1)
    got = (weight * model.labels[best]).sum(1)
    return np.where(total > 0, got / np.where(total > 0, total, 1), model.prior).clip(0, 1)


def score(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (doc_id) and score of every row of ``docs``."""
    columns = columns or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model.__dict__)
    docs = docs.select(F.col("text").alias("_text"), *columns)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, count = Model(**shared.value), Counter()
        for batch in batches:
            for lo, hi in slices(batch.num_rows, BLOCK):
                part = batch.slice(lo, hi - lo)
                s = vote(project(count(part.column(0)), m.idf, m.projection), m)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(s)], names=[*columns, "score"])

    return docs.mapInArrow(bounded(run), schema)


def op10_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of the held-out fold are not read."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 4, 2)).select("doc_id", "quality")
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
                      (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op10_quality_knn": op10_quality_knn}
