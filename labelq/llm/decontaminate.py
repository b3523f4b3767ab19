"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items.

Every run of SIZE consecutive words of an item is a pattern (an item of fewer words, but not none, is one
pattern itself).  Patterns and texts are normalised alike (lower-case words joined by one space), so the automaton
reads each text once and reports every pattern in it, whatever lies between the words.  Matches become word
intervals, merged per document and mapped back to places in the original text.

The patterns are the only data broadcast: at most BLOCK_BYTES of pattern text at a time (about 40 bytes of automaton a
byte).  A larger benchmark is dealt by pattern hash into as many blocks as that takes; each block is a further scan whose
intervals and items join those of the blocks before.  Documents are never shuffled; a text is read whole by one task.

Defined results: null and blank texts have no words and no hits; a very long text is one row of one task; a repeated
document gets the same result for every row; a repeated item_id is listed once; items of equal text are all listed; a
null item_id hits words but is never listed; without items (or items with words) nothing is hit; extra columns of either
table are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelq.llm.common import bounded, materialize, read, small_batches
from labelq.llm.wordbytes import character_places, normalised, word_places, words

#: Words of a window.
SIZE = 10
#: Bytes of patterns in one automaton.
BLOCK_BYTES = 2 << 20
#: Rows of one output batch.
ROWS = 256

_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def item_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """``window, items`` of every distinct window of ``benchmark`` (item_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(text)
                got = {b" ".join(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else ()
                ids += [item] * len(got)
                found += got
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(ids, pa.int64())], names=["window", "item"])

    pairs = benchmark.select(F.col("item_id").cast("long").alias("item"), "text").mapInArrow(run, "window binary, item long")
    return pairs.groupBy("window").agg(F.collect_set("item").alias("items"))  # collect_set leaves nulls out


class Automaton:
    """Patterns and their items; ``find`` gives the merged word intervals and the items of a text."""

    def __init__(self, windows: Sequence[bytes], items: Sequence[Sequence[int]]):
        self.items = items
        self.lengths = [w.count(b" ") + 1 for w in windows]
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, w in enumerate(windows):
            # Latin-1 turns bytes into characters one by one; the spaces around make matches end at words.
            self.machine.add_word(f" {w.decode('latin-1')} ", k)
        self.machine.make_automaton()

    def find(self, text_words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Intervals as rows of (first word, word after the last), and the items."""
        if not text_words or not self.lengths:
            return np.zeros((0, 2), np.int64), set()
        hits = list(self.machine.iter(f" {b' '.join(text_words).decode('latin-1')} "))
        if not hits:
            return np.zeros((0, 2), np.int64), set()
        ends, which = np.array(hits, np.int64).T
        # A match ends with the space after its last word; the k-th word is followed by the k-th of these spaces.
        after = np.cumsum(np.fromiter(map(len, text_words), np.int64, len(text_words)) + 1)
        last = np.searchsorted(after, ends, "left") + 1
        kinds = np.unique(which).tolist()
        return merged(np.stack([last - np.array(self.lengths)[which], last], 1)), {i for k in kinds for i in self.items[k]}


def merged(spans: np.ndarray) -> np.ndarray:
    """Intervals united where they overlap or touch, in order."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    heads = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.stack([spans[heads, 0], reach[np.append(heads[1:] - 1, len(spans) - 1)]], 1)


def _original(text: str, spans: np.ndarray) -> list[dict]:
    """Word intervals as code point intervals of ``text``."""
    first, end = word_places(normalised(text))
    at = character_places(text, np.stack([first[spans[:, 0]], end[spans[:, 1] - 1]], 1))
    return [{"start": int(a), "end": int(b)} for a, b in at]


def find_contamination(docs: DataFrame, benchmark: DataFrame, columns: Sequence[str] = ("doc_id",), size: int = SIZE,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``columns``, n_words, n_hit, items (sorted ids) and spans (start, end: code points of the text) of every row of
    ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    windows = materialize(item_windows(benchmark, size), "windows")
    total = windows.agg(F.sum(F.length("window") + 8 * F.size("items"))).head()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    names = [f"_c{i}" for i in range(len(columns))]
    state = docs.select(F.col("text").alias("_text"), *[F.col(c).alias(n) for c, n in zip(columns, names)],
                        F.array().cast("array<long>").alias("_at"), F.array().cast("array<long>").alias("_items"))
    kept = ", ".join(f"{n} {state.schema[n].dataType.simpleString()}" for n in names)
    for k in range(blocks):
        block = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k).toArrow()
        shared = spark.sparkContext.broadcast({"windows": block["window"].to_pylist(), "items": block["items"].to_pylist()})
        last = k == blocks - 1
        task = bounded(_scan(shared, len(names), last))
        if last:
            state = state.mapInArrow(task, f"{kept}, n_words long, n_hit long, items array<long>, spans array<struct<start:int,end:int>>")
        else:
            state = materialize(state.mapInArrow(task, f"_text string, {kept}, _at array<long>, _items array<long>"), "scan")
    return state.withColumnsRenamed(dict(zip(names, columns)))


def _scan(shared, n_kept: int, last: bool):
    """Task of one block: adds its intervals and items to the row's, or ends the row when it is the last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        if "automaton" not in held:  # once per worker, not per task
            held["automaton"] = Automaton(held["windows"], held["items"])
        automaton = held["automaton"]
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                n_words, n_hit, items, spans, ats = [], [], [], [], []
                for text, at, seen in zip(part.column(0).to_pylist(), part.column(1 + n_kept).to_pylist(), part.column(2 + n_kept).to_pylist()):
                    text_words = words(text)
                    found, got = automaton.find(text_words)
                    if at:
                        found = merged(np.concatenate([found, np.array(at, np.int64).reshape(-1, 2)]))
                    n_words.append(len(text_words))
                    n_hit.append(int((found[:, 1] - found[:, 0]).sum()))
                    items.append(sorted(got.union(seen)))
                    if last:
                        spans.append(_original(text, found) if len(found) else [])
                    else:
                        ats.append(found.ravel())
                kept = part.columns[1:1 + n_kept]
                names = [f"_c{i}" for i in range(n_kept)]
                listed = pa.array(items, pa.list_(pa.int64()))
                if last:
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), listed, pa.array(spans, _SPANS)],
                                                     names=[*names, "n_words", "n_hit", "items", "spans"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), *kept, pa.array(ats, pa.list_(pa.int64())), listed],
                                                     names=["_text", *names, "_at", "_items"])

    return run


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.col("items").cast("array<string>"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op13_decontamination": op13_decontamination}

ORACLE_SQL = {"op13_decontamination": r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id, w, least(10, len(w)) AS size FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0),
pattern AS (
  SELECT DISTINCT item_id, size, array_to_string(w[k:k + size - 1], ' ') AS p
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS k FROM item)),
place AS (
  SELECT r, k, size, array_to_string(w[k:k + size - 1], ' ') AS p
  FROM (SELECT r, w, s.size, unnest(range(1, len(w) - s.size + 2)) AS k FROM doc JOIN (SELECT DISTINCT size FROM pattern) s ON len(w) >= s.size)),
hit AS (SELECT r, k, size, item_id FROM place JOIN pattern USING (size, p)),
covered AS (SELECT r, count(DISTINCT k + i) AS n FROM (SELECT DISTINCT r, k, size FROM hit), unnest(range(0, size)) AS u(i) GROUP BY r),
listed AS (SELECT r, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids
           FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(l.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered c USING (r) LEFT JOIN listed l USING (r)
"""}
