"""Ranked lexical search: a document FP-tree per chunk of documents, searched by branch and bound for each item.

1. A scan keeps, for every document with a term, its number of terms and the counts of the items' terms (the
   restricted vector), in a table of the shared folder.  N, L and the document frequencies are aggregates of it.
2. Each task reads its documents in chunks.  The terms of a vector are ordered by falling document frequency, so
   documents of equal leading terms share a path of the tree.  Sorted that way a subtree is a range of documents; a node
   splits its range by the first term that not all of it share.  Every node holds the largest tf of each term and the smallest
   m of its subtree; as a score rises with tf and falls with m, these bound the scores below.  Each item walks the tree
   depth first, the better child first, and leaves out subtrees whose bound is below its k-th best score so far, which
   it carries from chunk to chunk.
3. A task returns its k best documents per item; two rankings (first within salts of an item) give the k best of all.

Bounded parameters: items are dealt by hash into passes of at most about PASS_BYTES of item text; a pass is what is broadcast
and one scan of all documents.  Within a pass, trees cover blocks of items of at most BLOCK_TERMS terms together
(one item may have more) and CELLS matrix cells.  Results do not depend on any of them.

Defined results: null and blank texts have no term, are not counted and never found; a very long text is one row of one
task; repeated documents are found as often as they are there; equal scores are ranked by doc_id, null last; rows of one
item_id are one item of all their terms, null ids included; items without terms, or whose terms no document has, return
nothing, like empty tables; extra columns are ignored whatever their names.  Weights are logarithms in doubles, all else whole numbers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelq.llm.common import bounded, discard, materialize, read, small_batches
from labelq.llm.wordbytes import words

TOP = 50
PASS_BYTES = 4 << 20
BLOCK_TERMS = 4096
CELLS = 1 << 22
#: Documents of a subtree that is scored at once.
LEAF = 32
SALTS = 32
_LAST = np.iinfo(np.int64).max


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's share of the score before its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class FPTree:
    """Tree over restricted vectors.  ``tf`` has a row per document and a column per term, the most frequent first."""

    def __init__(self, tf: np.ndarray, m: np.ndarray):
        n, width = tf.shape
        bits = np.packbits(tf > 0, axis=1)
        keys = [row.tobytes() for row in bits]
        # Falling bit rows: at the first term that two documents do not share, the one that has it comes first.
        self.order = np.array(sorted(range(n), key=keys.__getitem__, reverse=True), np.int64)
        bits, self.m = bits[self.order], m[self.order]
        tf = tf[self.order]
        self.impacts = np.zeros((n, width), np.int32)  # at most 10**6
        at = np.nonzero(tf)
        self.impacts[at] = impact(tf[at].astype(np.int64), self.m[at[0]])
        self._split(bits, width)
        self._bounds(tf)

    def _split(self, bits: np.ndarray, width: int) -> None:
        n = len(bits)
        apart = bits[1:] ^ bits[:-1]
        byte = (apart != 0).argmax(1)
        value = apart[np.arange(n - 1), byte]
        # parts[i]: the first term that documents i and i + 1 do not share; width when they share all.
        parts = np.where(value > 0, 8 * byte + 7 - np.log2(np.maximum(value, 1)).astype(np.int64), width)
        self.lo, self.hi, self.left, self.right = [0], [n], [-1], [-1]
        todo = [0]
        while todo:
            node = todo.pop()
            lo, hi = self.lo[node], self.hi[node]
            if hi - lo <= LEAF:
                continue
            cut = lo + int(parts[lo:hi - 1].argmin())
            if parts[cut] == width:
                continue  # the same terms throughout
            for side, a, b in ((self.left, lo, cut + 1), (self.right, cut + 1, hi)):
                side[node] = len(self.lo)
                todo.append(len(self.lo))
                self.lo.append(a)
                self.hi.append(b)
                self.left.append(-1)
                self.right.append(-1)

    def _bounds(self, tf: np.ndarray) -> None:
        """Largest tf of each term and smallest m of every subtree, and the impacts that these bound."""
        nodes = len(self.lo)
        top = np.zeros((nodes, tf.shape[1]), tf.dtype)
        low = np.zeros(nodes, np.int64)
        leaves = sorted((i for i in range(nodes) if self.left[i] < 0), key=self.lo.__getitem__)
        starts = [self.lo[i] for i in leaves]
        top[leaves] = np.maximum.reduceat(tf, starts, axis=0)
        low[leaves] = np.minimum.reduceat(self.m, starts)
        for i in range(nodes - 1, -1, -1):  # children come after their parent
            if self.left[i] >= 0:
                np.maximum(top[self.left[i]], top[self.right[i]], out=top[i])
                low[i] = min(low[self.left[i]], low[self.right[i]])
        self.limits = np.zeros(top.shape, np.int32)
        at = np.nonzero(top)
        self.limits[at] = impact(top[at].astype(np.int64), low[at[0]])

    def search(self, terms: np.ndarray, weights: np.ndarray, best: "Best", ids: np.ndarray, absent: np.ndarray) -> int:
        """Offer ``best`` every document that its k-th score does not rule out; returns the number of nodes visited."""
        bound = (self.limits[:, terms] @ weights).tolist()
        stack, visited = [0], 0
        while stack:
            node = stack.pop()
            if bound[node] < best.least:
                continue
            visited += 1
            left, right = self.left[node], self.right[node]
            if left >= 0:
                stack += (left, right) if bound[right] > bound[left] else (right, left)
                continue
            lo, hi = self.lo[node], self.hi[node]
            score = self.impacts[lo:hi, terms] @ weights
            take = np.flatnonzero(score >= best.least)
            if len(take):
                rows = self.order[lo + take]
                best.offer(score[take], ids[rows], absent[rows])
        return visited


class Best:
    """The k best (score, doc_id) so far; ``least`` is what a further document must reach."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.score = np.zeros(0, np.int64)
        self.ids, self.absent = self.score, np.zeros(0, bool)

    def offer(self, score: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        score, ids, absent = np.append(self.score, score), np.append(self.ids, ids), np.append(self.absent, absent)
        keep = np.lexsort((absent, ids, -score))[:self.k]
        self.score, self.ids, self.absent = score[keep], ids[keep], absent[keep]
        if len(keep) == self.k:
            self.least = int(self.score[-1])


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, terms`` (distinct, as binary) of every item that has a term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(words(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])

    each = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, terms array<binary>")
    return each.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).where(F.size("terms") > 0)


def restricted_vectors(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every row of ``docs`` with a term: n counts all its terms, the lists those of ``terms`` by position."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(shared.value)}
        for batch in batches:
            sizes, found, counts = [], [], []
            for text in batch.column(1).to_pylist():
                w = words(text)
                known = sorted((place[t], c) for t, c in Counter(w).items() if t in place)
                sizes.append(len(w))
                found.append([p for p, _ in known])
                counts.append([c for _, c in known])
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())),
                                              pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array([s > 0 for s in sizes], pa.bool_()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .mapInArrow(bounded(run), "doc_id long, n long, terms array<int>, tfs array<int>")


def _blocks(items: list[tuple], limit: int) -> list[list[int]]:
    """Positions of items, dealt in order into blocks of at most ``limit`` terms together."""
    out, here, seen = [], [], set()
    for i, (_, terms) in enumerate(items):
        grown = seen.union(terms)
        if here and len(grown) > limit:
            out.append(here)
            here, grown = [], set(terms)
        here.append(i)
        seen = grown
    return [*out, here] if here else out


def _search(shared):
    """Task of a pass: the k best documents of its rows for every item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        best = [Best(at["k"]) for _ in at["items"]]
        place = [np.full(len(at["rank"]), -1, np.int64) for _ in at["blocks"]]
        asked = []
        for column, block in zip(place, at["blocks"]):
            terms = np.unique(np.concatenate([at["items"][i][1] for i in block]))  # by rank: the most frequent first
            column[terms] = np.arange(len(terms))
            asked.append((len(terms), [(i, column[at["items"][i][1]], at["weight"][at["items"][i][1]]) for i in block]))
        for batch in batches:
            total, ids, absent, m = batch.num_rows, *_columns(batch, at["n_docs"], at["n_terms"])
            for column, (width, wanted) in zip(place, asked):
                step = max(1, at["cells"] // width)
                for lo in range(0, total, step):
                    part = batch.slice(lo, step)
                    terms, tfs = part.column(2), part.column(3)
                    row = np.repeat(np.arange(part.num_rows), np.diff(terms.offsets.to_numpy()))
                    col = column[at["rank"][terms.flatten().to_numpy()]]
                    tf = np.zeros((part.num_rows, width), np.int32)
                    tf[row[col >= 0], col[col >= 0]] = tfs.flatten().to_numpy()[col >= 0]
                    tree = FPTree(tf, m[lo:lo + step])
                    for i, columns, weights in wanted:
                        tree.search(columns, weights, best[i], ids[lo:lo + step], absent[lo:lo + step])
        sizes = [len(b.score) for b in best]
        if sum(sizes):
            gather = lambda name: np.concatenate([getattr(b, name) for b in best])
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for (i, _), s in zip(at["items"], sizes) for _ in range(s)], pa.int64()),
                 pa.array(gather("ids"), pa.int64(), mask=gather("absent")), pa.array(gather("score"), pa.int64())], names=["item_id", "doc_id", "score"])

    return run


def _columns(batch: pa.RecordBatch, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids with nulls as the largest number, whether null, m) of a batch; m in Python's unbounded whole numbers first."""
    ids = batch.column(0)
    m = [50 + 50 * n * n_docs // n_terms for n in batch.column(1).to_pylist()]
    return ids.fill_null(_LAST).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), np.array(m, np.int64)


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, pass_bytes: int = PASS_BYTES, block_terms: int = BLOCK_TERMS,
           cells: int = CELLS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best rows of ``docs`` (doc_id, text) for every item (item_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    wanted = materialize(item_terms(items), "item-terms")
    total = wanted.select(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda s, t: s + F.length(t) + 8))).head()[0] or 0
    passes = max(1, -(-total // pass_bytes))
    found = None
    for p in range(passes):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).toArrow()
        got = _one_pass(docs, sorted(zip(rows["item_id"].to_pylist(), rows["terms"].to_pylist()), key=str), k, block_terms, cells)
        found = got if found is None else found.unionByName(got)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = Window.partitionBy("item_id", "_salt").orderBy(*order)
    last = Window.partitionBy("item_id").orderBy(*order)
    found = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= k)
    return found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _one_pass(docs: DataFrame, items: list[tuple], k: int, block_terms: int, cells: int) -> DataFrame:
    spark = docs.sparkSession
    schema = "item_id long, doc_id long, score long"
    vocabulary = sorted({t for _, terms in items for t in terms})
    vectors = materialize(restricted_vectors(docs, vocabulary), "vectors")
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).head()
    df = np.zeros(len(vocabulary), np.int64)
    counts = vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toArrow()  # one row a term of the pass
    df[counts["t"].to_numpy()] = counts["df"].to_numpy()
    frequent = np.lexsort((np.arange(len(df)), -df))
    rank = np.empty(len(df), np.int64)
    rank[frequent] = np.arange(len(df))
    place = {t: r for t, r in zip(vocabulary, rank.tolist()) if df[frequent[r]] > 0}
    asked = [(i, np.array(sorted(place[t] for t in terms if t in place), np.int64)) for i, terms in items]
    asked = [(i, terms) for i, terms in asked if len(terms)]
    if not asked:
        return spark.createDataFrame([], schema)
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df[frequent].tolist()]
    shared = spark.sparkContext.broadcast({
        "k": k, "n_docs": n_docs, "n_terms": n_terms, "rank": rank, "weight": np.array(weight, np.int64), "items": asked,
        "blocks": _blocks([(i, t.tolist()) for i, t in asked], block_terms), "cells": cells})
    found = materialize(vectors.mapInArrow(bounded(_search(shared)), schema), "found")
    discard(vectors)
    return found


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the 50 best documents of every benchmark item."""
    return ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op12_lexical_search": op12_lexical_search}

ORACLE_SQL = {"op12_lexical_search": r"""
WITH term AS (
  SELECT r, doc_id, t, count(*) AS tf FROM (
    SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents))
  GROUP BY ALL),
size AS (SELECT r, sum(tf) AS n FROM term GROUP BY r),
total AS (SELECT count(*) AS nn, sum(n) AS l FROM size),
measure AS (SELECT r, 50 + (50 * n * nn) // l AS m FROM size, total),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark),
weight AS (
  SELECT t, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT t, count(*) AS df FROM term WHERE t IN (SELECT t FROM wanted) GROUP BY t), total),
score AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM wanted JOIN weight USING (t) JOIN term USING (t) JOIN measure USING (r)
  GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM score WHERE score > 0)
WHERE rank <= 50
"""}
