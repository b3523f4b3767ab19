"""S3: files of several encodings read in byte ranges."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import types as T

from labelq.sources.by_header import Field
from labelq.sources.encodings import ENCODINGS, cut_records, decode_first, failing, read_chunks, read_csv_any_encoding

SCHEMA = T.StructType([T.StructField("ID", T.LongType()), T.StructField("sent", T.StringType())])
#: A character that makes a strict decode by the encodings before fail.
MARK = {"utf-8": "é", "shift_jis": "文", "cp932": "①", "euc-jp": "癰"}


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows_of(encoding, n, seed):
    rnd = random.Random(seed)
    letters = ["文", "章", "ア", "表", "ソ", "a", "b", " ", ",", '"', "\n", "\r\n", "能"]
    rows = []
    for i in range(n):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))
        if i == n // 2:
            text = 'x"\n,' * 15000  # longer than three byte ranges
        rows.append([str(i), text, MARK[encoding]])
    return rows


@pytest.mark.parametrize("encoding", ENCODINGS)
def test_file_of_many_ranges(spark, tmp_out, small_ranges, encoding):
    rows = rows_of(encoding, 1500, 3)
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n").writerows([["ID", "sent", "m"], *rows])
    data = out.getvalue().encode(encoding)
    path = os.path.join(tmp_out, f"{encoding}.csv")
    with open(path, "wb") as f:
        f.write(data)
    assert len(data) > 8 * 20000 and decode_first(data)[0] == encoding
    chunks = read_chunks(spark, tmp_out, chunk=3000)
    assert chunks.rdd.getNumPartitions() > 6 and chunks.select("block").distinct().count() > 5
    got = read_csv_any_encoding(spark, tmp_out, [Field("sent"), Field("ID", "int"), Field("mark", aliases=("m",))], chunk=3000, positions=True).collect()
    assert {r._encoding for r in got} == {encoding} and not any(r._bad for r in got)
    got.sort(key=lambda r: (r._block, r._seq, r._row))
    norm = lambda t: t.replace("\r\n", "\n") or None
    assert [(r.ID, r.sent and norm(r.sent), r.mark) for r in got] == [(int(i), norm(t), m) for i, t, m in rows]


def test_files_choose_their_own_encoding(spark, tmp_out, small_ranges):
    for enc in ENCODINGS:
        with open(os.path.join(tmp_out, f"{enc}.csv"), "wb") as f:
            # The character that decides comes last, ranges after the others.
            f.write(("sent,ID\r\n" + "".join(f"文章,{i}\r\n" for i in range(4000)) + f"{MARK[enc]},4000").encode(enc))
    with open(os.path.join(tmp_out, "none.csv"), "wb") as f:
        f.write(b"ID,sent\n1,\xff\xfe\xfd\x80\x81\n")
    open(os.path.join(tmp_out, "empty.csv"), "wb").close()
    out = read_csv_any_encoding(spark, tmp_out, SCHEMA)
    got = {(os.path.basename(r._file), r._encoding): r.n for r in out.groupBy("_file", "_encoding").count().withColumnRenamed("count", "n").collect()}
    assert got == {**{(f"{e}.csv", e): 4001 for e in ENCODINGS}, ("none.csv", None): 1}
    marks = {os.path.basename(r._file)[:-4]: r.sent for r in out.where("ID = 4000").collect()}
    assert marks == MARK


def test_bad_values_and_odd_rows_are_listed(spark, tmp_out):
    with open(os.path.join(tmp_out, "a.csv"), "w", encoding="cp932") as f:
        f.write('sent,ID\n①,1\n②,x\n\n③,3,4\n"④\nz",\n"never closed,5\n')
    out = read_csv_any_encoding(spark, tmp_out, SCHEMA).collect()
    got = {r.sent: (r.ID, [tuple(b) for b in r._bad]) for r in out}
    assert got == {"①": (1, []), "②": (None, [("ID", "x")]), "③": (3, [("*", "③,3,4")]), "④\nz": (None, []),
                   "never closed,5\n": (None, [("*", "never closed,5\n")])}


def test_cutting():
    assert cut_records('a,b\n"c\nd",e\n', False) == (None, [["a", "b"], ["c\nd", "e"]], None)
    assert cut_records('x",y\nz\n"open\n', True) == ('x",y\n', [["z"]], '"open\n')
    assert cut_records("all\ninside\n", True) == ("all\ninside\n", [], None)
    assert cut_records('"a" "b\n', False) == (None, [], '"a" "b\n')
    assert cut_records("", False) == (None, [], None)
    assert failing("①".encode("cp932")) == ["utf-8", "shift_jis", "euc-jp"]
