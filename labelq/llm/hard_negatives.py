"""Hard-negative mining with STR-packed R-trees over whole-number vectors.

The rows are written once, range-partitioned by (length, label, first component, vec_id).  Each task packs its rows, a chunk at a
time and one tree per length and label, by sort-tile-recursive slicing along the components of widest spread.  A node holds the
minimum bounding box of its rows and their smallest vec_id.  For an anchor a the inner product with any row in the box [lo, hi] lies in
    [a+ . lo + a- . hi, a+ . hi + a- . lo]        (a+ and a-: the positive and negative part of a).
A best-first queue opens the box of the greatest upper end first, for a block of anchors at a time.  An anchor passes over a
box whose interval lies outside its score window, or whose upper end is strictly below its k-th best score (or equals it
while all vec_ids are larger).

Two passes per block of anchors: the best rows of the anchor's own label over all tasks (positives), then, with a score window for
each positive, the best rows of other labels.  A task returns k rows per query; a ranking over all tasks gives the result.

Bounded parameters: a block has at most about ANCHOR_BYTES of vectors; it is what is broadcast and collected, and each block is two scans of
all rows.  Results do not depend on it, nor on CHUNK, LEAF, FAN or GROUP.

Defined results: rows with a null vec_id, label or vector, or a null or non-finite component, take no part; vectors of another length
have no score with the anchor (an empty vector scores 0 with empty ones); repeated rows count as often as they are there, rows that share the anchor's
vec_id are no others; equal scores go by vec_id; an anchor without positives, or a positive without a
negative in its window (always so below a score of 0), returns nothing, like an empty table; extra columns are ignored.  Scores are 64-bit integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelq.llm.common import bounded, materialize, read, small_batches

ANCHOR_BYTES = 8 << 20
#: Rows of the trees that are in memory at once.
CHUNK = 16384
#: Rows of a leaf, children of an inner node, anchors of one queue.
LEAF = 64
FAN = 16
GROUP = 512
#: Stands below every score.
_LOWEST = -(2**62)
_LAST = np.iinfo(np.int64).max


def quantised(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, vector``: the rows that take part, components as floor(256 * x), the label one further for ids divisible by 7."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda c: F.coalesce((c == c) & (F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(x, lambda c: F.floor(c * 256)).alias("vector"))


class RTree:
    """Rows of one length and label; ``levels`` run from the top boxes to the leaves."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        order = self._tiles(vectors, ids)
        self.vectors, self.ids = vectors[order], ids[order]
        starts = np.arange(0, len(ids), LEAF)
        low, high, first = (np.minimum.reduceat(self.vectors, starts, axis=0), np.maximum.reduceat(self.vectors, starts, axis=0),
                            np.minimum.reduceat(self.ids, starts))
        self.levels = [(low, high, first)]
        while len(self.levels[0][2]) > FAN:
            low, high, first = self.levels[0]
            starts = np.arange(0, len(first), FAN)
            self.levels.insert(0, (np.minimum.reduceat(low, starts, axis=0), np.maximum.reduceat(high, starts, axis=0), np.minimum.reduceat(first, starts)))

    @staticmethod
    def _tiles(vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Row order of sort-tile-recursive packing: cut into slabs along one component, each slab along the next."""
        spread = vectors.max(0) - vectors.min(0) if vectors.shape[1] else np.zeros(0)
        axes = np.argsort(-spread, kind="stable")
        out, todo = [], [(np.argsort(ids, kind="stable"), 0)]
        while todo:
            rows, depth = todo.pop()
            leaves = -(-len(rows) // LEAF)
            if leaves <= 1 or depth == len(axes):
                out.append(rows)
                continue
            slabs = max(2, int(np.ceil(leaves ** (1 / (len(axes) - depth)))))
            size = -(-leaves // slabs) * LEAF  # whole leaves
            rows = rows[np.argsort(vectors[rows, axes[depth]], kind="stable")]
            todo += [(rows[lo:lo + size], depth + 1) for lo in reversed(range(0, len(rows), size))]
        return np.concatenate(out)

    def search(self, top: "Top", anchors: np.ndarray) -> None:
        """Offer ``top`` the rows that its queries of ``anchors`` (positions) are not able to rule out."""
        queue, serial = [], 0

        def push(level: int, lo: int, hi: int, who: np.ndarray) -> None:
            nonlocal serial
            low, high, first = (x[lo:hi] for x in self.levels[level])
            plus, minus = top.plus[who], top.minus[who]
            upper, lower = plus @ high.T + minus @ low.T, plus @ low.T + minus @ high.T
            for c in range(hi - lo):
                heapq.heappush(queue, (-upper[:, c].max(), serial, level, lo + c, who, upper[:, c], lower[:, c], first[c]))
                serial += 1

        push(0, 0, len(self.levels[0][2]), anchors)
        while queue:
            _, _, level, node, who, upper, lower, first = heapq.heappop(queue)
            who = who[top.open(who, upper, lower, first)]
            if not len(who):
                continue
            if level + 1 < len(self.levels):
                push(level + 1, node * FAN, min(node * FAN + FAN, len(self.levels[level + 1][2])), who)
            else:
                rows = slice(node * LEAF, node * LEAF + LEAF)
                top.offer(who, top.vectors[who] @ self.vectors[rows].T, self.ids[rows])


class Top:
    """The k best rows of every query.  ``owner`` is the query's anchor, in order; a query takes scores from ``least`` to ``most``."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, owner: np.ndarray, least: np.ndarray, most: np.ndarray, k: int, skip_own: bool):
        self.vectors, self.ids, self.owner, self.least, self.most, self.k, self.skip_own = vectors, ids, owner, least, most, k, skip_own
        self.plus, self.minus = np.maximum(vectors, 0), np.minimum(vectors, 0)
        self.score = np.full((len(owner), k), _LOWEST, vectors.dtype)
        self.row = np.full((len(owner), k), _LAST, np.int64)
        self.first = np.searchsorted(owner, np.arange(len(ids) + 1))

    def _queries(self, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries of the anchors ``who``, position in ``who`` of each)."""
        n = self.first[who + 1] - self.first[who]
        at = np.repeat(np.arange(len(who)), n)
        return np.repeat(self.first[who] - np.cumsum(n) + n, n) + np.arange(len(at)), at

    def open(self, who: np.ndarray, upper: np.ndarray, lower: np.ndarray, first: int) -> np.ndarray:
        """Which anchors have a query that a box may hold a better row for."""
        q, at = self._queries(who)
        up, worst = upper[at], self.score[q, -1]
        use = (up >= self.least[q]) & (lower[at] <= self.most[q]) & ((up > worst) | ((up == worst) & (first <= self.row[q, -1])))
        out = np.zeros(len(who), bool)
        out[at[use]] = True
        return out

    def offer(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        q, at = self._queries(who)
        s = scores[at]
        take = (s >= self.least[q, None]) & (s <= self.most[q, None]) & (s >= self.score[q, -1:])
        if self.skip_own:
            take &= ids != self.ids[who][at, None]
        row, col = np.nonzero(take)
        if not len(row):
            return
        hit = np.unique(row)
        query = np.concatenate([q[row], np.repeat(q[hit], self.k)])
        score, which = np.concatenate([s[row, col], self.score[q[hit]].ravel()]), np.concatenate([ids[col], self.row[q[hit]].ravel()])
        order = np.lexsort((which, -score, query))
        query, score, which = query[order], score[order], which[order]
        heads = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        rank = np.arange(len(query)) - np.repeat(heads, np.diff(np.append(heads, len(query))))
        best = rank < self.k
        self.score[query[best], rank[best]], self.row[query[best], rank[best]] = score[best], which[best]


def _vectors(column: pa.Array, dtype: type) -> tuple[np.ndarray, list[np.ndarray]]:
    """(length of every list, its numbers)."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(dtype)
    return np.diff(offsets), [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _task(shared, own_label: bool, k: int):
    """Task of one pass: (anchor, anchor_id, wanted, vec_id, score) of the k best rows of its own for every query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        dtype = at["dtype"]
        tops = []  # a group of anchors of one length each
        lengths = np.array([len(v) for v in at["vectors"]], np.int64)
        for length in np.unique(lengths):
            members = np.flatnonzero(lengths == length)
            for lo in range(0, len(members), GROUP):
                group = members[lo:lo + GROUP]
                place = np.full(len(lengths), -1, np.int64)
                place[group] = np.arange(len(group))
                use = np.flatnonzero(place[at["owner"]] >= 0)
                use = use[np.argsort(place[at["owner"][use]], kind="stable")]
                top = Top(np.stack([at["vectors"][i] for i in group]).astype(dtype), at["ids"][group], place[at["owner"][use]],
                          at["least"][use], at["most"][use], k, own_label)
                tops.append((int(length), group, use, at["labels"][group], top))

        def search(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            sizes, vectors = _vectors(rows.column(2), dtype)
            ids, labels = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            for length, label in {*zip(sizes.tolist(), labels.tolist())}:
                asked = [(t, np.flatnonzero((of == label) == own_label)) for n, _, _, of, t in tops if n == length]
                if any(len(who) for _, who in asked):
                    here = np.flatnonzero((sizes == length) & (labels == label))
                    tree = RTree(np.stack([vectors[i] for i in here]), ids[here])
                    for top, who in asked:
                        if len(who):
                            tree.search(top, who)

        held, n = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                if n + part.num_rows > CHUNK:
                    search(held)
                    held, n = [], 0
                if part.num_rows:
                    held.append(part)
                    n += part.num_rows
        if n:
            search(held)
        for _, group, use, _, top in tops:
            q, r = np.nonzero(top.score > _LOWEST)
            if len(q):
                anchor = group[top.owner[q]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(at["ids"][anchor]), pa.array(at["wanted"][use[q]]), pa.array(top.row[q, r]),
                     pa.array(top.score[q, r].astype(np.int64))], names=["anchor", "anchor_id", "wanted", "vec_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("anchor", "wanted").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


_FOUND = "anchor long, anchor_id long, wanted long, vec_id long, score long"


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for every row of ``rows`` (vec_id, label, vector:
    array<bigint>) with ``is_anchor`` and each of its ``positives`` best rows of the same label, the ``negatives`` best rows of other labels
    whose score is ``low`` to ``high`` percent of the positive's."""
    spark = rows.sparkSession
    small_batches(spark)
    keys = [F.size("vector"), F.col("label"), F.get("vector", F.lit(0)), F.col("vec_id")]
    rows = materialize(rows.select("vec_id", "label", "vector").repartitionByRange(*keys), "tiles")
    size = F.size("vector").cast("long")
    total, widest, largest = rows.agg(
        F.sum(F.when(is_anchor, 8 * size + 24)), F.max(size), F.max(F.array_max(F.transform("vector", F.abs)))).head()
    # Doubles add up these whole numbers exactly as long as every sum stays below 2**53.
    dtype = np.float64 if (largest or 0) ** 2 * (widest or 0) < 2**53 else np.int64
    blocks = max(1, -(-(total or 0) // anchor_bytes))
    out = None
    for b in range(blocks):
        got = _block(rows, rows.where(is_anchor & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)), positives, negatives, low, high, dtype)
        out = got if out is None else out.unionByName(got)
    return out


def _block(rows: DataFrame, anchors: DataFrame, positives: int, negatives: int, low: int, high: int, dtype: type) -> DataFrame:
    spark = rows.sparkSession
    held = anchors.orderBy("vec_id", "label", "vector").toArrow()
    n = held.num_rows
    vectors = [np.array(v, np.int64) for v in held["vector"].to_pylist()]
    base = {"vectors": vectors, "ids": held["vec_id"].to_numpy(), "labels": held["label"].to_numpy(), "dtype": dtype}
    everything = {"owner": np.arange(n), "wanted": np.zeros(n, np.int64), "least": np.full(n, _LOWEST + 1), "most": np.full(n, 2**62)}
    shared = spark.sparkContext.broadcast({**base, **everything})
    pairs = materialize(_best(rows.mapInArrow(bounded(_task(shared, True, positives)), _FOUND), positives), "positives")
    windows = pairs.select("anchor", F.col("score").alias("wanted")).where("score >= 0").distinct().orderBy("anchor", "wanted").toArrow()
    wanted = windows["wanted"].to_numpy()
    asked = {"owner": windows["anchor"].to_numpy(), "wanted": wanted, "least": -((-low * wanted) // 100), "most": high * wanted // 100}
    shared = spark.sparkContext.broadcast({**base, **asked})
    found = _best(rows.mapInArrow(bounded(_task(shared, False, negatives)), _FOUND), negatives)
    found = found.select("anchor", "wanted", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = pairs.select("anchor", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = pairs.join(found, (pairs["anchor"] == found["anchor"]) & (pairs["positive_score"] == found["wanted"]))
    return materialize(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows whose vec_id is divisible by 100."""
    return hard_negatives(quantised(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


QUERIES = {"op11_hard_negatives": op11_hard_negatives}

ORACLE_SQL = {"op11_hard_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS r, CAST(vec_id AS BIGINT) AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
anchor AS (SELECT * FROM v WHERE vec_id % 100 = 0),
scored AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, v.r AS r, v.vec_id AS vec_id, a.label = v.label AS same,
         CASE WHEN len(a.q) = 0 THEN 0 ELSE CAST(list_dot_product(a.q, v.q) AS BIGINT) END AS score
  FROM anchor a JOIN v ON len(a.q) = len(v.q) AND (a.label <> v.label OR a.vec_id <> v.vec_id)),
positive AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS k FROM scored WHERE same) WHERE k <= 5),
negative AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.r ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positive p JOIN scored n ON p.a = n.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 5
"""}
