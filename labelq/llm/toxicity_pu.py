"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts and unlabelled texts train linear classifiers with the sigmoid loss in numpy.  The
unlabelled risk holds positives in the share of the class prior; their expected part is taken out, and while the
rest, the risk of the negatives, is below zero it counts as zero (non-negative estimator).  Texts
are sets of 64-bit word hashes (letters only, A-Z folded); the vocabulary keeps words that are clearly more
frequent in the confirmed texts.  ``MEMBERS`` classifiers, each fitted to its own share of the rows, are
averaged.

The training sample is bounded and documented: at most MAX_POSITIVE confirmed and about MAX_UNLABELLED
unlabelled texts, taken by a hash of doc_id; every text is scored, whole.  The prior is a
parameter; by default it is the toxic share of the labelled training rows.

Defined results: null and empty texts get the score of a text without known words; repeated rows get equal
scores; null labels are no evidence; without any confirmed text every score is the prior (0 without labels); a null
doc_id is scored and never held out; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelq.llm.bytesops import WordHasher, byte_values, slices, text_bytes
from labelq.llm.common import bounded, read, small_batches

MAX_POSITIVE = 3000
MAX_UNLABELLED = 8000
MAX_VOCABULARY = 20000
MEMBERS = 3
TABLE_BITS = 20


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def word_sets(texts: DataFrame) -> DataFrame:
    """``positive, words`` (sorted distinct word hashes) of rows (positive, text)."""
    values = byte_values("letters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(values)
        for batch in batches:
            for lo, hi in slices(batch.num_rows, 512):
                part = batch.slice(lo, hi - lo)
                words, at = hasher(*text_bytes(part.column(1)))
                sets = [np.unique(words[a:b]).view(np.int64) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["positive", "words"])

    return texts.select("positive", "text").mapInArrow(bounded(run), "positive boolean, words array<long>")


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400, rate: float = 0.2,
             decay: float = 1e-5, max_vocabulary: int = MAX_VOCABULARY) -> tuple[np.ndarray, np.ndarray, float]:
    """(sorted vocabulary, weights, bias) of one classifier of word sets."""
    rows = positive + unlabelled
    n_p, n_u = len(positive), len(unlabelled)
    lengths = np.array([len(x) for x in rows], np.int64)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    vocabulary, term = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(rows)), lengths)
    in_p = np.bincount(term[row < n_p], minlength=len(vocabulary))
    in_u = np.bincount(term[row >= n_p], minlength=len(vocabulary))
    p, u = in_p / max(n_p, 1), (in_u + 1) / (n_u + 1)
    z = (p - u) / np.sqrt(u * (1 - np.minimum(u, 0.999)) / max(n_p, 1))
    keep = np.flatnonzero((in_p >= 3) & (z > 3) & (p > 2 * u))
    keep = np.sort(keep[np.argsort(-z[keep], kind="stable")[:max_vocabulary]])
    new = np.full(len(vocabulary), -1)
    new[keep] = np.arange(len(keep))
    used = new[term] >= 0
    term, row = new[term][used], row[used]
    is_p = np.arange(len(rows)) < n_p
    w, bias = np.zeros(len(keep)), np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    m, v = np.zeros(len(keep) + 1), np.zeros(len(keep) + 1)
    for step in range(1, steps + 1):
        g = bias + np.bincount(row, w[term], minlength=len(rows))
        s = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
        # Sigmoid loss: a row called positive costs s, one called negative 1 - s.
        negative = s[~is_p].mean() - prior * s[is_p].mean() if n_u and n_p else 0.0
        slope = s * (1 - s)
        from_p = np.where(is_p, -prior * slope / max(n_p, 1), 0.0)
        from_n = np.where(is_p, -prior * slope / max(n_p, 1), slope / max(n_u, 1))
        pull = from_p + from_n if negative >= 0 else from_p
        grad = np.append(np.bincount(term, pull[row], minlength=len(keep)) + decay * w, pull.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return vocabulary[keep], w, float(bias)


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Classifiers from ``labels`` (doc_id, toxic; training rows only) and the texts of ``docs``."""
    small_batches(docs.sparkSession)
    n_toxic, n_labels = labels.agg(F.count_if(F.col("toxic") == 1), F.count("toxic")).first()
    prior = prior if prior is not None else (n_toxic / n_labels if n_labels else 0.0)
    if not n_toxic:
        none = np.zeros(0, np.uint64)
        return [(none, np.zeros(0), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))]
    ids = labels.where("toxic = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_POSITIVE)
    confirmed = docs.join(F.broadcast(ids), "doc_id", "left_semi").select(F.lit(True).alias("positive"), "text").limit(2 * MAX_POSITIVE)
    every = max(1, docs.count() // MAX_UNLABELLED)
    anyone = docs.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(every)) == 0).select(F.lit(False).alias("positive"), "text")
    rows = word_sets(confirmed.unionByName(anyone.limit(4 * MAX_UNLABELLED))).toArrow()
    sets = [x.values.to_numpy().view(np.uint64) for x in rows["words"]]
    flags = rows["positive"].to_pylist()
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), sets[i][:8].tobytes(), sets[i][-8:].tobytes(), flags[i]))
    p, u = [sets[i] for i in order if flags[i]], [sets[i] for i in order if not flags[i]]
    # Each member leaves out another third of the unlabelled rows.
    return [fit_nnpu(p, [x for i, x in enumerate(u) if i % MEMBERS != k] or u, prior) for k in range(MEMBERS)]


def score(docs: DataFrame, models: list[tuple[np.ndarray, np.ndarray, float]]) -> DataFrame:
    """doc_id, score (mean of the members' probabilities) of every row; vocabularies are bounded by MAX_VOCABULARY."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    values = byte_values("letters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(values)
        members = []
        for vocabulary, w, bias in shared.value:
            # A table over the hash's top bits finds the few words that may be known; the search confirms them.
            near = np.zeros(1 << TABLE_BITS, bool)
            near[(vocabulary >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
            members.append((vocabulary, w, bias, near))
        for batch in batches:
            for lo, hi in slices(batch.num_rows, 512):
                part = batch.slice(lo, hi - lo)
                words, at = hasher(*text_bytes(part.column(1)))
                total = np.zeros(hi - lo)
                top = (words >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
                for vocabulary, w, bias, near in members:
                    g = np.full(hi - lo, bias)
                    maybe = np.flatnonzero(near[top])
                    if len(maybe) and len(vocabulary):
                        place = np.minimum(np.searchsorted(vocabulary, words[maybe]), len(vocabulary) - 1)
                        known = vocabulary[place] == words[maybe]
                        doc = np.searchsorted(at, maybe[known], "right") - 1
                        pairs = np.unique(doc * len(vocabulary) + place[known])
                        g += np.bincount(pairs // len(vocabulary), w[pairs % len(vocabulary)], minlength=hi - lo)
                    total += 1 / (1 + np.exp(-np.clip(g, -40, 40)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total / len(members))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(bounded(run), "doc_id long, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of the held-out fold are not read."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 3, 1)).select("doc_id", "toxic")
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score",
                      (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
