"""N-gram Jaccard self-join with several global token orders.

A text is the set of 64-bit hashes of its n-word shingles.  Texts with equal sets form one class, whose
smallest doc_id stands for it.  If two sets reach the threshold, their prefixes (the first
n - ceil(t n) + 1 tokens) share a token under every global order, so a pair must pass the prefix test
under all ``ORDERS`` orders before it is verified on the whole sets.  The first order puts frequent tokens
last (frequencies of all shingles, kept in hash buckets of one byte, at most 2 ** MAX_SKETCH_BITS of them); the
others are seeded hash orders.

Candidates are never made as all pairs of a group.  First each token's texts are compared
with the token's smallest text only; verified links contract into components.  Then only pairs of
texts in different components are made, between the texts outside a token's largest component and all its
texts: a large group of near copies is by then one component and makes no pairs.  A shared token makes
a pair only if its positions in both orders leave room for the overlap the threshold needs (the pair's first
shared token does), which ends groups of copies that differ a little too much.  Pairs inside
a component cannot change the components, so nothing is lost.

Defined results: null, empty and blank texts have no shingles and link with nothing; a text of fewer than n words is
one shingle; repeated rows and equal sets link (intersection = union); rows with a null doc_id are returned
with a null component; repeated doc_ids get the component of the id; empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelq.llm.bytesops import WordHasher, byte_values, mix, slices, text_bytes
from labelq.llm.common import bounded, discard, materialize, read, small_batches
from labelq.llm.graph import components

#: Text bytes per bucket of the frequency sketch, and its largest size (2 ** 27 buckets of one byte).
BUCKET_BYTES = 32
MAX_SKETCH_BITS = 27
#: Pieces of the sketch, and sums that are made of each piece before the last one.
SKETCH_PARTS = 512
SKETCH_SUMS = 8
#: Bits of the bitmap of wanted ids.
ID_BITS = 24
ORDERS = 3


class Shingler:
    """Distinct shingle hashes of texts."""

    def __init__(self, n: int):
        self.n = n
        self.hasher = WordHasher(byte_values("words", seed=11))

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        words, at = self.hasher(*text_bytes(column))
        n = self.n
        with np.errstate(over="ignore"):
            size = max(len(words) - n + 1, 0)
            grams = np.zeros(size, np.uint64)
            for k in range(n):
                grams = grams * np.uint64(0xD6E8FEB86659FD93) + words[k:k + size]
            grams = mix(grams)
            out = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if b - a >= n:
                    out.append(np.unique(grams[a:b - n + 1]))
                elif b > a:  # the whole sequence, told apart from sequences of other lengths
                    h = np.uint64(b - a)
                    for w in words[a:b]:
                        h = h * np.uint64(0xD6E8FEB86659FD93) + w
                    out.append(mix(np.array([h])))
                else:
                    out.append(np.zeros(0, np.uint64))
        return out


def sketch_bits(docs: DataFrame) -> int:
    """Bits of the sketch: about one bucket per BUCKET_BYTES of text, at most MAX_SKETCH_BITS."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max((total // BUCKET_BYTES).bit_length(), 16), MAX_SKETCH_BITS)


def sketch(docs: DataFrame, n: int, bits: int) -> np.ndarray:
    """Rough frequency of the shingles of every hash bucket over all of ``docs``: eight steps per doubling, one byte each.

    A task sends its counts as SKETCH_PARTS compressed pieces; they are added in two steps, so a piece never
    gathers more than a share of the tasks.  The driver receives 2 ** ``bits`` bytes, a piece at a time."""
    size, own = 1 << bits, (1 << bits) // SKETCH_PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        shingles, total = Shingler(n), np.zeros(size, np.uint32)
        for batch in batches:
            for lo, hi in slices(batch.num_rows, 256):
                sets = shingles(batch.column(0).slice(lo, hi - lo))
                at, count = np.unique((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
                total[at] += count.astype(np.uint32)
        salt, codec = int.from_bytes(os.urandom(2)) % SKETCH_SUMS, pa.Codec("zstd", 1)
        # Small counts as bytes compress well; the few larger ones follow apart.
        for part in range(SKETCH_PARTS if total.any() else 0):
            c = total[part * own:(part + 1) * own]
            big = np.flatnonzero(c > 255)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([salt]), pa.array([codec.compress(np.minimum(c, 255).astype(np.uint8).tobytes(), asbytes=True)], pa.binary()),
                                              pa.array([big.astype(np.int64).tobytes()], pa.binary()), pa.array([c[big].astype(np.int64).tobytes()], pa.binary())],
                                             names=["part", "salt", "low", "at", "more"])

    def added(pdf):
        total, codec = np.zeros(own, np.int64), pa.Codec("zstd", 1)
        for low, at, more in zip(pdf["low"], pdf["at"], pdf["more"], strict=True):
            c = np.frombuffer(codec.decompress(low, own, asbytes=True), np.uint8).astype(np.int64)
            c[np.frombuffer(at, np.int64)] = np.frombuffer(more, np.int64)
            total += c
        return total

    def some(pdf):
        import pandas as pd

        total = added(pdf)
        big = np.flatnonzero(total > 255)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "low": [pa.Codec("zstd", 1).compress(np.minimum(total, 255).astype(np.uint8).tobytes(), asbytes=True)],
                             "at": [big.astype(np.int64).tobytes()], "more": [total[big].tobytes()]})

    def all_(pdf):
        import pandas as pd

        steps = np.minimum(np.round(8 * np.log2(np.maximum(added(pdf), 1))), 255).astype(np.uint8)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "low": [steps.tobytes()]})

    rows = docs.select("text").mapInArrow(bounded(run), "part long, salt long, low binary, at binary, more binary")
    rows = rows.groupBy("part", "salt").applyInPandas(some, "part long, low binary, at binary, more binary")
    out = np.zeros(size, np.uint8)
    rows = materialize(rows.groupBy("part").applyInPandas(all_, "part long, low binary"), "ngram-sketch")
    for part, steps in rows.toLocalIterator():
        out[part * own:(part + 1) * own] = np.frombuffer(steps, np.uint8)
    discard(rows)
    return out


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _order_seeds() -> np.ndarray:
    return np.random.default_rng(5).integers(1, 2**63, ORDERS, dtype=np.uint64)


def signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, first (prefix under the frequency order) of every row."""
    bits = sketch_bits(docs)
    shared = docs.sparkSession.sparkContext.broadcast(sketch(docs, n, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        shingles, counts, seed = Shingler(n), shared.value, _order_seeds()[0]
        for batch in batches:
            for lo, hi in slices(batch.num_rows, 256):
                part = batch.slice(lo, hi - lo)
                sizes, digests, first = [], [], []
                for s in shingles(part.column(1)):
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    df = counts[(s >> np.uint64(64 - bits)).astype(np.int64)]
                    order = np.lexsort((mix(s ^ seed), df))
                    first.append(s[order[:prefix_length(len(s), percent)]].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(first, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "digest", "first"])

    return docs.select("doc_id", "text").mapInArrow(bounded(run), "doc_id long, n_shingles long, digest binary, first array<long>")


def whole_sets(docs: DataFrame, wanted: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, s (whole set), rest (prefixes under the hash orders) of the documents in ``wanted`` (doc_id) and a few more.

    The ids are sent as a bitmap of their hashes with 2 ** ID_BITS bits, whatever their number, so the
    texts are filtered where they are scanned and are not shuffled; a fuller bitmap only lets more pass."""
    place = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << ID_BITS) - 1))
    ored = wanted.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (ID_BITS - 6), np.int64)
    bitmap[ored["w"].to_numpy()] = ored["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, bits, seeds = Shingler(n), shared.value, _order_seeds()
        for batch in batches:
            p = batch.column(2).to_numpy()
            batch = batch.filter(pa.array(((bits[p >> 6] >> (p & 63)) & 1).astype(bool)))
            for lo, hi in slices(batch.num_rows, 256):
                part = batch.slice(lo, hi - lo)
                sets, rest = [], []
                for s in shingles(part.column(1)):
                    k = prefix_length(len(s), percent)
                    sets.append(s.view(np.int64))
                    rest.append([s[np.argpartition(mix(s ^ x), k - 1)[:k]].view(np.int64) if k else sets[-1] for x in seeds[1:]])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64())), pa.array(rest, pa.list_(pa.list_(pa.int64())))],
                                                 names=["doc_id", "s", "rest"])

    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text", place.alias("p"))
    return rows.mapInArrow(bounded(run), "doc_id long, s array<long>, rest array<array<long>>")


def _verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Links among ``pairs`` (a < b): prefix tests under the other orders, then whole sets."""
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = materialize(whole_sets(docs, wanted, n, percent), "ngram-sets")
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("rest").alias("_ra")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("rest").alias("_rb")), "b")
    for k in range(ORDERS - 1):
        both = both.where(F.arrays_overlap(F.col("_ra")[k], F.col("_rb")[k]))
    pairs = materialize(both.select("a", "b").distinct(), "ngram-candidates")
    found = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("_sa")), "a") \
        .join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("_sb")), "b")
    common = F.size(F.array_intersect("_sa", "_sb"))
    links = materialize(found.select("a", "b", common.alias("_i"), (F.size("_sa") + F.size("_sb")).alias("_n"))
                        .where(100 * F.col("_i") >= percent * (F.col("_n") - F.col("_i"))).select("a", "b").distinct(), "ngram-links")
    discard(sets, pairs)
    return links


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text): texts link when
    100 * |A and B| >= ``percent`` * |A or B| over their sets of ``n``-word shingles."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(signatures(docs, n, percent), "ngram-signatures")
    # Classes of equal sets, joined over shared doc_ids too (a repeated id is one document).
    known = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = materialize(known.groupBy("digest").agg(F.min("doc_id").alias("rep")), "ngram-classes")
    reps = known.join(classes, (known["doc_id"] == classes["rep"]) & (known["digest"] == classes["digest"]), "left_semi")
    reps = materialize(reps.select("doc_id", "n_shingles", "first"), "ngram-reps")
    # From here on only the representatives need their prefixes.
    narrow = materialize(rows.drop("first"), "ngram-rows")
    discard(rows)
    rows, known = narrow, narrow.where("doc_id IS NOT NULL AND n_shingles > 0")

    postings = reps.select("doc_id", F.col("n_shingles").alias("size"), F.posexplode("first").alias("at", "token"))
    groups = postings.groupBy("token").agg(F.count("*").alias("_n"), F.min(F.struct("doc_id", "size", "at")).alias("_p")).where("_n > 1")
    postings = materialize(postings.join(groups, "token").select("token", "doc_id", "size", "at", "_p"), "ngram-postings")
    discard(reps)

    def fits(size: str, at: str, other: str, other_at: str):
        # Positions before the first shared token match nothing: the rest of the shorter text bounds the overlap.
        room = F.least(F.col(size) - F.col(at), F.col(other) - F.col(other_at))
        return (100 + percent) * room >= percent * (F.col(size) + F.col(other))

    star = postings.where((F.col("doc_id") != F.col("_p.doc_id")) & fits("size", "at", "_p.size", "_p.at")) \
        .select(F.least("_p.doc_id", "doc_id").alias("a"), F.greatest("_p.doc_id", "doc_id").alias("b")).distinct()
    star = materialize(star, "ngram-star")
    links = _verified(star, docs, n, percent)
    comp = materialize(components(links), "ngram-components")

    # Tokens that still join different components: texts outside the token's largest component meet all of its texts.
    placed = postings.join(comp, postings["doc_id"] == comp["node"], "left") \
        .select("token", "doc_id", "size", "at", F.coalesce("component", "doc_id").alias("comp"))
    parts = placed.groupBy("token", "comp").agg(F.count("*").alias("n"))
    top = parts.groupBy("token").agg(F.max(F.struct("n", "comp")).alias("t"), F.count("*").alias("k")).where("k > 1")
    mixed = materialize(placed.join(top.select("token", F.col("t.comp").alias("top")), "token"), "ngram-mixed")
    discard(postings)
    minor = mixed.where("comp <> top").select("token", F.col("doc_id").alias("x"), F.col("size").alias("xs"), F.col("at").alias("xa"),
                                              F.col("comp").alias("xc"))
    cross = minor.join(mixed.drop("top"), "token").where((F.col("xc") != F.col("comp")) & fits("xs", "xa", "size", "at")) \
        .select(F.least("x", "doc_id").alias("a"), F.greatest("x", "doc_id").alias("b")).distinct()
    cross = materialize(cross.join(star, ["a", "b"], "left_anti"), "ngram-cross")
    discard(mixed, star)
    links = links.unionByName(_verified(cross, docs, n, percent))
    discard(cross)

    # Rows of one class link with their representative; a doc_id with several texts joins their classes.
    same = known.join(classes, "digest").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    comp = components(links.unionByName(same.distinct()))
    out = rows.join(comp, rows["doc_id"] == comp["node"], "left")
    return out.select(rows["doc_id"], "n_shingles", F.coalesce("component", rows["doc_id"]).alias("component_id"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 3-word shingles and a Jaccard similarity of 90 percent or more."""
    return ngram_components(read(spark, sf_dir, "documents"), 3, 90)


QUERIES = {"op3_ngram_jaccard": op3_ngram_jaccard}
