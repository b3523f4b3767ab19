"""Removal of byte strings that repeat across documents, by a difference-cover suffix array.

A byte goes when it is covered by a ``LENGTH``-byte string that also starts in a document with a
smaller doc_id.  Three passes over the documents:

1. Every LENGTH-byte string is represented by its minimiser, the smallest hash of its GRAM-byte parts.  Minimisers
   are counted by hash in buckets; the ones found in two or more documents go to a bitmap of fixed size
   (2 ** BITMAP_BITS bits).  A string whose minimiser is in one document only cannot repeat.
2. The remaining text, as runs of strings with one minimiser, is dealt by minimiser, so equal strings
   meet in one task.  There a difference-cover suffix array (period 3) is built over the different runs of each minimiser that has several: triples at
   positions 1 and 2 mod 3 are sorted and named, the names are sorted recursively, the
   suffixes at positions 0 mod 3 are sorted by first byte and rank, and both orders are merged.  Neighbours with equal
   LENGTH-byte prefixes form a class with its smallest doc_id.
3. The covered intervals join their documents, which are cut.

A minimiser with HOT or more different runs (a frequent line with other neighbours in every document) is not dealt as
one: each of its strings is dealt alone, by its own hash, so equal strings still meet and different ones spread.  Most
of those strings are a border of the frequent line and found once, so a pass of their own counts them by hash in a
second bitmap of the same size, and only the ones found in two or more documents travel.

Equal runs are collapsed before the shuffle and before sorting, so a passage in a third of all documents costs one run
per batch.  A batch judges its equal runs itself: all but those of its smallest document are covered whatever the other
batches hold, and leave as merged intervals; the smallest document's go on to the suffix array.  The bitmaps only
skip work: strings that pass them by chance are told apart by the suffix array.

Defined results: null and empty texts have no bytes; texts shorter than LENGTH stay whole; documents with a
null doc_id stay whole and remove nothing elsewhere; rows with equal doc_id do not affect each other, repeated
rows get equal results; very long texts are read in overlapping pieces; empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelq.llm.bytesops import PIECE, mix, slices, text_bytes
from labelq.llm.common import bounded, freed_shuffles, materialize, read, small_batches

LENGTH = 50
GRAM = 24
BITMAP_BITS = 27
#: Bits of a minimiser's hash; the low bits hold its place while the smallest is sought.
HASH_BITS = 44
#: Distinct bytes per suffix array (more only when one minimiser has more).
CHUNK = 1 << 18
#: Different runs of one minimiser, summed over the batches that hold two or more, from which its strings are dealt alone.
HOT = 4096
#: Strings that wait in a task to be collapsed.
WAITING = 1 << 17
#: Text bytes per counting bucket.
BUCKET_BYTES = 4 << 20


class Runs:
    """Maximal runs of LENGTH-byte strings with one minimiser, of the texts of a column."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per piece: hash, text number, first byte (in ``raw``) and one past the last byte of each run."""
        lo, end = int(offsets[0]), int(offsets[-1])
        while end - lo >= self.length:
            hi = min(lo + PIECE - self.length, end - self.length + 1)  # strings that start in [lo, hi)
            yield self._piece(raw[lo:hi + self.length - 1], lo, offsets)
            lo = hi

    def _piece(self, b: np.ndarray, lo: int, offsets: np.ndarray):
        n, low = len(b) - self.length + 1, np.uint64((1 << (64 - HASH_BITS)) - 1)
        with np.errstate(over="ignore"):
            words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(b, 8)).view(np.uint64).ravel()
            m = len(b) - self.gram + 1
            h = words[:m] * np.uint64(0x9E3779B97F4A7C15)
            for at in range(8, self.gram, 8):
                at = min(at, self.gram - 8)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words[at:at + m]
            h = (mix(h) & ~low) | np.arange(m, dtype=np.uint64)
        width, span = self.length - self.gram + 1, 1
        while 2 * span <= width:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        if span < width:
            h = np.minimum(h[:len(h) - (width - span)], h[width - span:])
        h = h[:n]
        # Strings that cross into the next text are not strings of a document.
        a, z = np.searchsorted(offsets, lo, "right") - 1, np.searchsorted(offsets, lo + n + self.length - 1, "left")
        valid = np.ones(n, bool)
        for cut in (offsets[a + 1:z] - lo).tolist() if z - a < 64 else ():
            valid[max(cut - self.length + 1, 0):cut] = False
        if z - a >= 64:
            mark = np.zeros(n + 1, np.int32)
            cuts = offsets[a + 1:z] - lo
            np.add.at(mark, np.clip(cuts - self.length + 1, 0, n), 1)
            np.add.at(mark, np.clip(cuts, 0, n), -1)
            valid = np.cumsum(mark[:-1]) == 0
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = (h[1:] != h[:-1]) | ~valid[:-1]
        starts = np.flatnonzero(new & valid)
        stops = np.append(np.flatnonzero(new | ~valid), n)
        stops = stops[np.searchsorted(stops, starts, "right")]
        text = np.searchsorted(offsets, starts + lo, "right") - 1
        # The smallest of many hashes is small: mixed once more, minimisers fill buckets and bitmap evenly.
        return mix(h[starts] & ~low) >> np.uint64(64 - HASH_BITS), text, starts + lo, stops + lo + self.length - 1


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``s`` (integers above 0) by the difference cover {1, 2} mod 3."""
    n = len(s)
    if n < 8:
        values = s.tolist()
        return np.array(sorted(range(n), key=lambda i: values[i:]), np.int64)
    t = np.zeros(n + 4, np.int64)
    t[:n] = s
    base = int(t.max()) + 1

    def pair(i: np.ndarray) -> tuple[np.ndarray, int]:
        """Order-keeping numbers of (t[i], t[i + 1]) and their bound."""
        return t[i] * base + t[i + 1], base * base

    def packed(high: np.ndarray, bound: int, low: np.ndarray, size: int) -> np.ndarray:
        if bound * size >= 1 << 62:
            high = np.unique(high, return_inverse=True)[1]
        return high * size + low

    cover = np.arange(n + (n % 3 == 1))
    one, two = cover[1::3], cover[2::3]
    place = np.concatenate([one, two])
    first, bound = pair(place)
    names, name = np.unique(packed(first, bound, t[place + 2], base), return_inverse=True)  # sorted triples
    if len(names) < len(place):
        order = suffix_array(name + 1)
        ranks = np.empty(len(place), np.int64)
        ranks[order] = np.arange(1, len(place) + 1)
    else:
        ranks, order = name + 1, np.argsort(name)
    rank = np.zeros(n + 4, np.int64)
    rank[place] = ranks
    sample = place[order]
    sample = sample[sample < n]
    size = len(place) + 2
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(t[rest] * size + rank[rest + 1], kind="stable")]
    # Merge: against positions 1 mod 3 compare (byte, rank), against 2 mod 3 (byte, byte, rank).
    a, b = sample[sample % 3 == 1], sample[sample % 3 == 2]
    before = np.searchsorted(t[a] * size + rank[a + 1], t[rest] * size + rank[rest + 1])
    both, bound = pair(np.concatenate([b, rest]))
    keys = packed(both, bound, rank[np.concatenate([b, rest]) + 2], size)
    before += np.searchsorted(keys[:len(b)], keys[len(b):])
    at = before + np.arange(len(rest))
    out, free = np.empty(n, np.int64), np.ones(n, bool)
    out[at], free[at] = rest, False
    out[free] = sample
    return out


def smallest_owner(runs: list[bytes], owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every string of ``length`` bytes of ``runs``: (run, place in it, smallest owner of an equal string)."""
    sizes = np.array([len(r) for r in runs], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    data = np.ones(int(begin[-1]) + 8, np.int64)
    text = np.frombuffer(b"\0".join(runs) + b"\0", np.uint8)
    data[:len(text)] = text.astype(np.int64) + 2
    data[begin[1:] - 1] = 1  # ends of runs sort before all bytes
    order = suffix_array(data[:int(begin[-1])])
    run = np.searchsorted(begin, order, "right") - 1
    whole = order + length <= begin[run] + sizes[run]
    order, run = order[whole], run[whole]
    # Adjacent prefixes, eight bytes at a time.
    raw = np.zeros(len(text) + length + 8, np.uint8)
    raw[:len(text)] = text
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view(np.uint64).ravel()
    same = np.ones(max(len(order) - 1, 0), bool)
    for at in sorted({*range(0, length - 7, 8), length - 8}):
        w = words[order + at]
        same &= w[1:] == w[:-1]
    heads = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.zeros(0, np.int64)
    low = np.minimum.reduceat(owner[run], heads) if len(heads) else np.zeros(0, np.int64)
    members = np.diff(np.append(heads, len(order)))
    return run, order - begin[run], np.repeat(low, members)


def bucketed(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket (the upper ``bits`` bits) of sorted hashes and their short hashes: the next bits, at most 32."""
    width = min(32, HASH_BITS - bits)
    short = (h >> np.uint64(HASH_BITS - bits - width)) & np.uint64((1 << width) - 1)
    return (h >> np.uint64(HASH_BITS - bits)).astype(np.int64), short.astype(np.uint32)


def bucket_bits(short: np.ndarray, bits: int) -> bytes:
    """A bucket's part of the bitmap: the bits of the short hashes that come twice."""
    h = np.sort(short)
    h = h[1:][h[1:] == h[:-1]]
    own = np.zeros(1 << (BITMAP_BITS - bits), bool)
    own[h >> np.uint32(min(32, HASH_BITS - bits) - (BITMAP_BITS - bits))] = True
    return np.packbits(own).tobytes()


def different_runs(raw: np.ndarray, h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes with two or more different runs of at least 8 bytes, sorted, and how many each has."""
    order = np.argsort(h, kind="stable")
    h, begin, end = h[order], begin[order], end[order]
    same = h[1:] == h[:-1]
    more = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
    if not len(more):
        return h[:0], np.zeros(0, np.int64)
    h, begin, end = h[more], begin[more], end[more]
    words = np.lib.stride_tricks.sliding_window_view(raw, 8)
    value = (end - begin).astype(np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, int((end - begin).max()), 8):
            w = np.ascontiguousarray(words[np.minimum(begin + at, end - 8)]).view(np.uint64).ravel()
            value = mix((value ^ w) * np.uint64(0x9E3779B97F4A7C15))
    order = np.lexsort((value, h))
    h, value = h[order], value[order]
    h = h[np.concatenate([[True], (h[1:] != h[:-1]) | (value[1:] != value[:-1])])]
    names, count = np.unique(h, return_counts=True)
    return names[count > 1], count[count > 1]


def string_hashes(raw: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """HASH_BITS-bit hashes of the strings of ``length`` (8 or more) bytes that start at ``at``."""
    words = np.lib.stride_tricks.sliding_window_view(raw, 8)
    value = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for step in sorted({*range(0, length - 7, 8), length - 8}):
            w = np.ascontiguousarray(words[at + step]).view(np.uint64).ravel()
            value = (value ^ (value >> np.uint64(29)) ^ w) * np.uint64(0x9E3779B97F4A7C15)
        return mix(value) >> np.uint64(64 - HASH_BITS)


def starts_within(begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of all strings of ``length`` bytes in the runs [begin, end), and the number of each one's run."""
    size = end - begin - length + 1
    run = np.repeat(np.arange(len(begin)), size)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + begin[run], run


def is_hot(hashes: np.ndarray, hot: np.ndarray, lacking: int) -> np.ndarray:
    """Which of the hashes have their upper bits among the sorted ``hot``."""
    if not len(hot):
        return np.zeros(len(hashes), bool)
    name = hashes >> np.uint64(lacking)
    return hot[np.minimum(np.searchsorted(hot, name), len(hot) - 1)] == name


def in_bitmap(seen: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes >> np.uint64(HASH_BITS - BITMAP_BITS)
    return ((seen[(bit >> np.uint64(3)).astype(np.int64)] >> (7 - (bit & np.uint64(7))).astype(np.uint8)) & 1).astype(bool)


def merged(doc: np.ndarray, key: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Intervals [a, z) of texts (doc, key), those that touch as one."""
    if not len(doc):
        return doc, key, a, z
    order = np.lexsort((a, key, doc))
    doc, key, a, z = doc[order], key[order], a[order], z[order]
    text = np.concatenate([[0], np.cumsum((doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))])
    span = int(z.max()) + 1
    reach = np.maximum.accumulate(z + text * span)  # the furthest end so far of the same text
    heads = np.flatnonzero(np.concatenate([[True], (a + text * span)[1:] > reach[:-1]]))
    last = np.append(heads[1:], len(a)) - 1
    return doc[heads], key[heads], a[heads], reach[last] - text[heads] * span


Found = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _counted(docs: DataFrame, bits: int, items: Callable[[np.ndarray, np.ndarray], Found]) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the hashes that occur in two or more rows (2 ** BITMAP_BITS / 8 bytes reach the driver) and the sorted
    upper bits of the hot ones, at most one per HOT runs of the table.  ``items`` gives (hash, text number) of all that is counted and
    (hash, different runs) of what may be hot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, hot, hot_count = [], [], []
            raw, offsets = text_bytes(batch.column(0))
            for hashes, text, names, many in items(raw, offsets):
                hot.append(names)
                hot_count.append(many)
                found.append(np.unique(hashes + (text.astype(np.uint64) << np.uint64(HASH_BITS))))
            if not sum(map(len, found)):
                continue
            low = np.uint64((1 << HASH_BITS) - 1)
            h = np.sort(np.unique(np.concatenate(found)) & low)
            h = h[np.concatenate([[True, True], h[2:] != h[:-2]])[:len(h)]]  # two of a kind say enough
            bucket, short = bucketed(h, bits)
            heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            parts = np.split(short, heads[1:])
            several = {}
            where, short = bucketed(np.concatenate(hot), bits)
            for b, x, many in zip(where.tolist(), short.tolist(), np.concatenate(hot_count).tolist(), strict=True):
                several.setdefault(b, []).append((x, many))
            numbers = [np.array(several.get(b, []), np.uint32).tobytes() for b in bucket[heads].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[heads]), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array(numbers, pa.binary())],
                                             names=["bucket", "h", "several"])

    def repeated(pdf):
        import pandas as pd

        part = bucket_bits(np.frombuffer(b"".join(pdf["h"]), np.uint32), bits)
        pairs = np.frombuffer(b"".join(pdf["several"]), np.uint32).reshape(-1, 2)
        names, at = np.unique(pairs[:, 0], return_inverse=True)
        sums = np.bincount(at, pairs[:, 1], len(names))
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "bits": [part], "hot": [names[sums >= HOT].tobytes()]})

    rows = docs.select("text").mapInArrow(bounded(count), "bucket long, h binary, several binary") \
        .groupBy("bucket").applyInPandas(repeated, "bucket long, bits binary, hot binary")
    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    step = 1 << (BITMAP_BITS - bits - 3)
    width, hot = min(32, HASH_BITS - bits), [np.zeros(0, np.uint64)]
    for bucket, part, names in rows.toLocalIterator():
        out[bucket * step:(bucket + 1) * step] = np.frombuffer(part, np.uint8)
        hot.append(np.frombuffer(names, np.uint32).astype(np.uint64) + np.uint64(bucket << width))
    return out, np.sort(np.concatenate(hot))


def _filters(docs: DataFrame, length: int) -> tuple[Broadcast, Broadcast]:
    """Broadcast (bitmap of repeated minimisers, hot minimisers, how many lower bits those lack) and the bitmap of the repeated
    strings of hot minimisers (empty without hot ones): 2 ** BITMAP_BITS / 8 bytes each."""
    context = docs.sparkSession.sparkContext
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(8, (total // BUCKET_BYTES).bit_length()), BITMAP_BITS - 3)
    gram, lacking = min(GRAM, length), HASH_BITS - bits - min(32, HASH_BITS - bits)

    def minimisers(raw: np.ndarray, offsets: np.ndarray) -> Found:
        for hashes, text, begin, end in Runs(length, gram)(raw, offsets):
            names, many = different_runs(raw, hashes, begin, end)
            yield hashes, text, names, many

    seen, hot = _counted(docs, bits, minimisers)
    first = context.broadcast((seen, hot, lacking))
    if not len(hot):
        return first, context.broadcast(np.zeros(0, np.uint8))

    def strings(raw: np.ndarray, offsets: np.ndarray) -> Found:
        _, hot, lacking = first.value
        none = np.zeros(0, np.uint64)
        for hashes, text, begin, end in Runs(length, gram)(raw, offsets):
            alone = np.flatnonzero(is_hot(hashes, hot, lacking))
            at, run = starts_within(begin[alone], end[alone], length)
            yield string_hashes(raw, at, length), text[alone][run], none, none.astype(np.int64)

    return first, context.broadcast(_counted(docs, bits, strings)[0])


def repeated_intervals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, key (xxhash64 of the text), spans (begin, end): covered byte intervals, not yet merged."""
    docs = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length)).select("text", "doc_id", F.xxhash64("text").alias("key"))
    first, second = _filters(docs, length)
    gram = min(GRAM, length)
    columns, longs = ["h", "run", "places"], pa.list_(pa.int64())

    def packed(grouped: dict) -> Iterator[pa.RecordBatch]:
        """The runs with the places (doc_id, key, first byte) in their smallest document; then, without a run, the merged
        intervals (doc_id, key, begin, end) of the others."""
        items = list(grouped.items())
        for lo, hi in slices(len(items), 20000):
            part = items[lo:hi]
            sizes = np.array([len(x[1]) for x in part])
            places = np.array([y for x in part for y in x[1]], np.int64).reshape(-1, 3)
            which = np.repeat(np.arange(len(part)), sizes)
            least = np.minimum.reduceat(places[:, 0], np.cumsum(sizes) - sizes)
            own = places[:, 0] == least[which]
            bounds = 3 * np.concatenate([[0], np.cumsum(np.bincount(which[own], minlength=len(part)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0][0] for x in part], pa.int64()), pa.array([x[0][1] for x in part], pa.binary()),
                 pa.ListArray.from_arrays(bounds, pa.array(places[own].ravel()))], names=columns)
            size = np.array([len(x[0][1]) for x in part], np.int64)[which]
            spans = np.stack(merged(*places[~own].T, places[~own, 2] + size[~own]), 1)
            if len(spans):
                yield pa.RecordBatch.from_arrays([pa.array(spans[0, 1:2]), pa.nulls(1, pa.binary()), pa.array([spans.ravel()], longs)], names=columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, (seen, hot, lacking), repeated = Runs(length, gram), first.value, second.value
        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            ids, keys = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            # Equal runs of one batch travel once, with the places they come from.
            grouped: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
            data = raw.tobytes() if raw.base is None else memoryview(raw)
            for hashes, text, begin, end in runs(raw, offsets):
                keep = np.flatnonzero(in_bitmap(seen, hashes))
                alone = is_hot(hashes[keep], hot, lacking)
                apart, keep = keep[alone], keep[~alone]
                if len(apart):
                    at, run = starts_within(begin[apart], end[apart], length)
                    again = in_bitmap(repeated, string_hashes(raw, at, length))
                    at, own = at[again], text[apart][run[again]]
                    for d, k, p, a in zip(ids[own].tolist(), keys[own].tolist(), (at - offsets[own]).tolist(), at.tolist(), strict=True):
                        one = bytes(data[a:a + length])
                        grouped.setdefault((zlib.crc32(one), one), []).append((d, k, p))
                        if len(grouped) > WAITING:
                            yield from packed(grouped)
                            grouped = {}
                own = text[keep]
                for h, d, k, p, a, z in zip(hashes[keep].tolist(), ids[own].tolist(), keys[own].tolist(), (begin[keep] - offsets[own]).tolist(),
                                            begin[keep].tolist(), end[keep].tolist(), strict=True):
                    grouped.setdefault((h, bytes(data[a:z])), []).append((d, k, p))
            yield from packed(grouped)

    def judged(batch: pa.Table) -> pa.RecordBatch:
        texts = batch.column("run").to_pylist()
        number: dict[bytes, int] = {}
        row_run = np.array([number.setdefault(t, len(number)) for t in texts], np.int64)
        lists = batch.column("places").combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
        sizes = np.diff(lists.offsets.to_numpy()) // 3
        ids, keys, starts = np.ascontiguousarray(lists.flatten().to_numpy().reshape(-1, 3).T)
        run_of = np.repeat(row_run, sizes)
        owner = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(owner, run_of, ids)
        runs = list(number)
        span = np.array([len(r) for r in runs], np.int64)
        # A minimiser left with one run has all its strings from one document: nothing to sort.
        name = np.zeros(len(runs), np.int64)
        name[row_run] = batch.column("h").to_numpy()
        _, group, size = np.unique(name, return_inverse=True, return_counts=True)
        several = np.flatnonzero(size[group] > 1)
        run, place, low = smallest_owner([runs[i] for i in several.tolist()], owner[several], length)
        run = several[run]
        # Strings of a run's smallest owner that a smaller document has too, as intervals of places.
        hit = low < owner[run]
        key = np.sort(run[hit] * (1 << 40) + place[hit])
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1] + 1])) if len(key) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(key)) - 1 if len(key) else first
        part_run, part_a, part_z = key[first] >> 40, key[first] & ((1 << 40) - 1), (key[last] & ((1 << 40) - 1)) + length
        others = np.flatnonzero(ids > owner[run_of])
        own = np.flatnonzero(ids == owner[run_of])
        begin_at, end_at = np.searchsorted(part_run, run_of[own], "left"), np.searchsorted(part_run, run_of[own], "right")
        count = end_at - begin_at
        who = np.repeat(own, count)
        which = np.repeat(begin_at - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum())) if len(own) else np.zeros(0, np.int64)
        doc, k, a, z = merged(
            np.concatenate([ids[others], ids[who]]), np.concatenate([keys[others], keys[who]]),
            np.concatenate([starts[others], starts[who] + part_a[which]]),
            np.concatenate([starts[others] + span[run_of[others]], starts[who] + part_z[which]]))
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(k), pa.array(a), pa.array(z)], names=["doc_id", "key", "a", "z"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            done = batch.filter(batch.column(1).is_null())
            if done.num_rows:
                spans = done.column(2).flatten().to_numpy().reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.ascontiguousarray(spans.T)], names=["doc_id", "key", "a", "z"])
                batch = batch.filter(batch.column(1).is_valid())
            h = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[last is not None and h[0] != last], h[1:] != h[:-1]])) if len(h) else []
            lo = 0
            for at in list(cuts):
                if size + at - lo > CHUNK // (2 * LENGTH):
                    held.append(batch.slice(lo, at - lo))
                    yield judged(pa.Table.from_batches(held).combine_chunks())
                    held, size, lo = [], 0, at
            held.append(batch.slice(lo))
            size += batch.num_rows - lo
            last = h[-1] if len(h) else last
        if size:
            yield judged(pa.Table.from_batches(held).combine_chunks())

    parts = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = docs.mapInArrow(bounded(cut), "h long, run binary, places array<long>")
    dealt = runs.repartition(parts, "h").sortWithinPartitions("h")
    return dealt.mapInArrow(bounded(sort), "doc_id long, key long, a long, z long")


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text and others);
    with ``keep_text`` also all columns of ``docs``, and ``text`` without the removed characters (a character goes when
    all its bytes go)."""
    small_batches(docs.sparkSession)
    found = repeated_intervals(docs.select("doc_id", "text"), length)
    found = found.groupBy("doc_id", "key").agg(F.collect_list(F.struct("a", "z")).alias("_spans"))
    with freed_shuffles(docs.sparkSession):
        found = materialize(found.withColumnsRenamed({"doc_id": "_id", "key": "_key"}), "suffix-spans")
    rows = docs if keep_text else docs.select("doc_id", "text")
    rows = rows.withColumn("_k", F.xxhash64("text"))
    rows = rows.join(found, (rows["doc_id"] == found["_id"]) & (rows["_k"] == found["_key"]), "left").drop("_id", "_key", "_k")
    names = [c for c in rows.columns if c not in ("_spans", "text")]
    rows = rows.select("text", F.col("_spans.a").alias("_a"), F.col("_spans.z").alias("_z"), *names)
    added = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    passed = ["doc_id"] if not keep_text else names
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in passed), *(["text string"] if keep_text else []), added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, a, z in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode()
                kept, whole, gone, spans, at, done = [], [], 0, 0, 0, 0
                if a.is_valid:
                    a, z = np.sort(a.values.to_numpy()), np.sort(z.values.to_numpy())
                    # Sorted ends close a span where fewer intervals have ended than begun.
                    first = np.flatnonzero(np.concatenate([[True], a[1:] > z[:-1]]))
                    for x, y in zip(a[first].tolist(), z[np.append(first[1:], len(a)) - 1].tolist(), strict=True):
                        kept.append(raw[at:x])
                        gone, spans, at = gone + y - x, spans + 1, y
                        if keep_text:
                            while x < y and raw[x] & 0xC0 == 0x80:
                                x += 1
                            while y > x and y < len(raw) and raw[y] & 0xC0 == 0x80:
                                y -= 1
                            whole.append(raw[done:x])
                            done = y
                kept.append(raw[at:])
                whole.append(raw[done:])
                out[0].append(len(raw))
                out[1].append(gone)
                out[2].append(spans)
                out[3].append(hashlib.sha256(b"".join(kept)).hexdigest())
                out[4].append(b"".join(whole).decode() if text.is_valid else None)
            same = [batch.column(batch.schema.get_field_index(c)) for c in passed]
            body = [pa.array(out[4], pa.string())] if keep_text else []
            yield pa.RecordBatch.from_arrays([*same, *body, *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.string())],
                                             names=[*passed, *(["text"] if keep_text else []), "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(bounded(run), schema)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 50-byte strings that start in an earlier document too."""
    return remove_repeats(read(spark, sf_dir, "documents"))


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
