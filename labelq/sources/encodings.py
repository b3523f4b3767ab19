"""Encoding fallback (S3): utf-8, shift_jis, cp932, euc-jp; the first that decodes the whole file strictly wins.

Spark's CSV ``encoding`` option cannot do this (Japanese charsets are refused unless a legacy flag is set, and a wrong charset then
yields U+FFFD instead of failing), and reading a file as one value holds it in one task.  Here a file is read in byte ranges:

1. A text scan deals every file's ranges to tasks.  In all four encodings the byte of a line feed is never part of another character,
   so lines are whole characters.  Tasks pack lines into chunks of about CHUNK bytes and note which encodings fail on a chunk and how
   many quotes it holds.  The chunks are written once to the shared folder.
2. Small aggregates of those notes give each file its encoding (no chunk fails) and each range its state at the start: inside a quoted value
   when an odd number of quotes precede it in the file.
3. A second scan decodes the chunks and cuts them into records, line breaks inside quotes included.  What a chunk border cuts in two - the
   end of one chunk, the beginning of the next, whole chunks between - is joined again by record.

The first record of a file is its header; columns are bound by name.  A quote belongs to a quoted value (doubled inside it); a stray one is not
told apart, and rows whose number of values differs from the header's are listed in ``_bad``.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelq.functions.text import py_strip
from labelq.session import materialize, ship_package
from labelq.sources.by_header import MISSING, Field, fields_of, parse_as

# Encodings tried in order.
ENCODINGS = ("utf-8", "shift_jis", "cp932", "euc-jp")
BOM = "﻿"
#: Bytes of lines in one chunk; a longer line is a chunk of its own.
CHUNK = 1 << 20
#: Longest value the CSV parser takes, in characters.
MAX_VALUE = 1 << 30


def decode_first(data: bytes, encodings: Sequence[str] = ENCODINGS) -> tuple[str | None, str | None]:
    """(encoding, text) of a whole value: the first strict decode."""
    for enc in encodings:
        try:
            text = data.decode(enc)
        except (UnicodeDecodeError, LookupError):
            continue
        return enc, text.removeprefix(BOM) if enc == "utf-8" else text
    return None, None


def failing(data: bytes, encodings: Sequence[str] = ENCODINGS) -> list[str]:
    """The encodings that cannot decode ``data`` strictly."""
    out = []
    for enc in encodings:
        try:
            data.decode(enc)
        except UnicodeDecodeError:
            out.append(enc)
    return out


def read_chunks(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS, chunk: int = CHUNK, glob: str = "*.csv") -> DataFrame:
    """``file, block, seq, data, before, quotes, failing``: lines of every file in chunks. ``block`` is where the byte range
    starts, ``seq`` counts its chunks, ``before`` and ``quotes`` are the quotes of the range before and in the chunk."""
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", glob).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))
    schema = "file string, block long, seq long, data binary, before long, quotes long, failing array<string>"
    names = ["file", "block", "seq", "data", "before", "quotes", "failing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seq, before, held, size = None, 0, 0, [], 0

        def packed() -> pa.RecordBatch:
            nonlocal seq, before, held, size
            data = b"".join(held)
            quotes = data.count(b'"')
            row = [at[0], at[1], seq, data, before, quotes, failing(data, encodings)]
            seq, before, held, size = seq + 1, before + quotes, [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], f) for v, f in zip(row, _TYPES)], names=names)

        for batch in batches:
            for file, block, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != at or size + len(line) > chunk:
                    if held:
                        yield packed()
                    if (file, block) != at:
                        at, seq, before = (file, block), 0, 0
                held += (line, b"\n")
                size += len(line) + 1
        if held:
            yield packed()

    return lines.mapInArrow(run, schema)


_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.string())]


def file_encodings(chunks: DataFrame, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """``file, encoding``: the first encoding that fails on no chunk, NULL when all fail."""
    failed = chunks.select("file", F.explode_outer("failing").alias("one")).groupBy("file").agg(F.collect_set("one").alias("failed"))
    tried = F.array(*[F.lit(e) for e in encodings])
    return failed.select("file", F.get(F.array_except(tried, "failed"), F.lit(0)).alias("encoding"))


def block_states(chunks: DataFrame) -> DataFrame:
    """``file, block, inside``: whether a byte range starts inside a quoted value."""
    counts = chunks.groupBy("file", "block").agg(F.sum("quotes").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def cut_records(text: str, inside: bool) -> tuple[str | None, list[list[str]], str | None]:
    """(end of a record begun before, records, beginning of a record that does not end here) of whole lines ``text``.

    Parts keep their line feeds; the first is all of ``text`` when no record begins in it."""
    lines = text.split("\n")[:-1]  # every line ends with a line feed
    first = 0
    while inside and first < len(lines):
        inside = lines[first].count('"') % 2 == 0
        first += 1
    head = "".join(f"{line}\n" for line in lines[:first]) if first else None
    start, open_ = len(lines), False
    for i in range(first, len(lines)):
        if not open_:
            start = i
        open_ ^= lines[i].count('"') % 2 == 1
    end = start if open_ else len(lines)
    tail = "".join(f"{line}\n" for line in lines[end:]) if open_ else None
    return head, parse_records(lines[first:end]), tail


def parse_records(lines: list[str]) -> list[list[str]]:
    """CSV records of lines without their line feeds; blank lines are none."""
    csv.field_size_limit(MAX_VALUE)
    return [r for r in csv.reader(f"{line.removesuffix(chr(13))}\n" for line in lines) if r]


#: Kinds of a cut piece: the end of a record begun before, a whole record, the beginning of one that goes on.
_END, _WHOLE, _BEGIN = 0, 1, 2


def _pieces(chunks: DataFrame) -> DataFrame:
    """``file, encoding, block, seq, n, kind, values, text``: whole records as values, cut ones as text."""
    schema = "file string, encoding string, block long, seq long, n long, kind int, values array<string>, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, encoding, block, seq, data, inside in zip(*(c.to_pylist() for c in batch.columns)):
                text = data.decode(encoding)
                if block == 0 and seq == 0:
                    text = text.removeprefix(BOM)
                head, records, tail = cut_records(text, inside)
                rows = [(0, _END, None, head)] if head is not None else []
                rows += [(i, _WHOLE, r, None) for i, r in enumerate(records)]
                rows += [(len(records), _BEGIN, None, tail)] if tail is not None else []
                n, kind, values, texts = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(rows), pa.string()), pa.array([encoding] * len(rows), pa.string()), pa.array([block] * len(rows), pa.int64()),
                     pa.array([seq] * len(rows), pa.int64()), pa.array(n, pa.int64()), pa.array(kind, pa.int32()), pa.array(values, pa.list_(pa.string())),
                     pa.array(texts, pa.string())], names=["file", "encoding", "block", "seq", "n", "kind", "values", "text"])

    return chunks.mapInArrow(run, schema)


def _joined(pieces: DataFrame) -> DataFrame:
    """Records that chunk borders cut, put together: a beginning and all ends up to the next beginning. There are at most two pieces per chunk."""
    in_file = Window.partitionBy("file").orderBy("block", "seq", "kind").rowsBetween(Window.unboundedPreceding, 0)
    chained = pieces.where(F.col("kind") != _WHOLE).withColumn("chain", F.count_if(F.col("kind") == _BEGIN).over(in_file))
    whole = chained.groupBy("file", "encoding", "chain").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "kind", "n", "text"))).alias("parts"))
    first = F.col("parts")[0]
    whole = whole.select("file", "encoding", first["block"].alias("block"), first["seq"].alias("seq"), first["n"].alias("n"),
                         F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [parse_records(t.split("\n")[:-1]) for t in batch.column(5).to_pylist()]
            rows = [i for i, records in enumerate(parsed) for _ in records]
            values = pa.array([r for records in parsed for r in records], pa.list_(pa.string()))
            kept = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:5]]
            yield pa.RecordBatch.from_arrays([*kept, values], names=["file", "encoding", "block", "seq", "n", "values"])

    return whole.mapInArrow(run, "file string, encoding string, block long, seq long, n long, values array<string>")


def read_records(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS, chunk: int = CHUNK, glob: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """(``file, encoding, block, seq, n, values``: every CSV record of the files below ``path``, in file order by the three numbers,
    ``file``: those that no encoding decodes)."""
    ship_package(spark)
    chunks = materialize(read_chunks(spark, path, encodings, chunk, glob), "chunks")
    states = block_states(chunks).join(file_encodings(chunks, encodings), "file")
    states = materialize(states, "states")  # one row per byte range: its size is known before it is joined
    asked = chunks.select("file", "block", "seq", "data", "before").join(states, ["file", "block"])
    asked = asked.where(F.col("encoding").isNotNull()).select(
        "file", "encoding", "block", "seq", "data", (F.col("inside") != (F.col("before") % 2 == 1)).alias("inside"))
    pieces = materialize(_pieces(asked), "records")
    whole = pieces.where(F.col("kind") == _WHOLE).drop("kind", "text")
    return whole.unionByName(_joined(pieces)), states.where(F.col("encoding").isNull()).select("file").distinct()


def read_csv_any_encoding(
    spark: SparkSession,
    path: str,
    schema: T.StructType | Sequence[Field],
    encodings: Sequence[str] = ENCODINGS,
    chunk: int = CHUNK,
    positions: bool = False,
    glob: str = "*.csv",
) -> DataFrame:
    """Rows of every file below ``path`` whose name matches ``glob`` with the declared fields, bound by header name and converted where that is possible, plus ``_file``,
    ``_encoding`` and ``_bad`` (values that do not convert; ``*`` for a row with another number of values than the header). A
    field the header lacks is NULL. With ``positions`` also ``_block, _seq, _row``, which sort the rows of a file. Undecodable files give
    one row with NULL fields and ``_encoding`` NULL, so they are visible, not lost."""
    fields = fields_of(schema)
    records, undecodable = read_records(spark, path, encodings, chunk, glob)
    place = F.struct("block", "seq", "n")
    heads = records.where((F.col("block") == 0) & (F.col("seq") == 0)).groupBy("file").agg(
        F.min_by("values", place).alias("header"), F.min(place).alias("_head"))
    rows = records.join(heads, "file").where(place > F.col("_head"))
    names = F.transform("header", lambda h: py_strip(h))
    values, bad = [], []
    for f in fields:
        at = F.coalesce(*[F.nullif(F.array_position(names, n), F.lit(0)) for n in (f.name, *f.aliases)])
        text = F.nullif(F.get("values", (at - 1).cast("int")), F.lit(""))
        value = parse_as(text, f.type)
        values.append(value.alias(f.name))
        if f.type.lower() != "string":
            wrong = text.isNotNull() & value.isNull() & ~F.lower(py_strip(text)).isin(*MISSING)
            bad.append(F.when(wrong, F.struct(F.lit(f.name).alias("column"), text.alias("value"))))
    bad.append(F.when(F.size("values") != F.size("header"), F.struct(F.lit("*").alias("column"), F.array_join("values", ",").alias("value"))))
    order = [F.col("block").alias("_block"), F.col("seq").alias("_seq"), F.col("n").alias("_row")] if positions else []
    out = rows.select(*values, F.col("file").alias("_file"), F.col("encoding").alias("_encoding"),
                      F.filter(F.array(*bad), lambda b: b.isNotNull()).alias("_bad"), *order)
    lost = undecodable.select(*[F.lit(None).cast(f.type).alias(f.name) for f in fields], F.col("file").alias("_file"),
                              F.lit(None).cast("string").alias("_encoding"), F.array().cast("array<struct<column:string,value:string>>").alias("_bad"),
                              *[F.lit(0).cast("long").alias(n) for n in (("_block", "_seq", "_row") if positions else ())])
    return out.unionByName(lost)
