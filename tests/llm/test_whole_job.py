"""Cases in which an operator once did less than its whole job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelq.llm import embedding_dedup, suffix_dedup


@pytest.mark.parametrize("bits", range(8, 25))
def test_suffix_dedup_bucket_arithmetic(bits):
    rng = np.random.default_rng(bits)
    h = np.sort(rng.integers(0, 1 << suffix_dedup.HASH_BITS, 3000, dtype=np.uint64))
    twice = np.sort(np.concatenate([h, h[::3]]))
    bucket, short = suffix_dedup.bucketed(twice, bits)
    assert (np.diff(bucket) >= 0).all() and 0 <= bucket[0] and bucket[-1] < 1 << bits
    got = np.zeros(1 << (suffix_dedup.BITMAP_BITS - 3), np.uint8)
    step = 1 << (suffix_dedup.BITMAP_BITS - bits - 3)
    for b in np.unique(bucket):
        got[b * step:(b + 1) * step] = np.frombuffer(suffix_dedup.bucket_bits(short[bucket == b], bits), np.uint8)
    bit = (h[::3] >> np.uint64(suffix_dedup.HASH_BITS - suffix_dedup.BITMAP_BITS)).astype(np.int64)
    assert ((got[bit >> 3] >> (7 - (bit & 7))) & 1).all()
    assert np.unpackbits(got).sum() <= len(np.unique(bit)) + 30  # and hardly any others


def links_of(x, threshold):
    """n_links and component_id by brute force; ids are row numbers."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = (u @ u.T) >= threshold
    np.fill_diagonal(hit, False)
    comp = np.arange(len(x))
    while True:
        low = np.minimum(comp, np.where(hit, comp[None, :], len(x)).min(axis=1))
        if (low == comp).all():
            return hit.sum(axis=1), comp
        comp = low


def check_links(spark, x, threshold=0.95, **options):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    n, comp = links_of(x, threshold)
    got = {r[0]: r[1:] for r in embedding_dedup.near_duplicates(df, threshold, **options).collect()}
    assert [got[i][0] for i in range(len(x))] == n.tolist()
    assert [got[i][1] for i in range(len(x))] == comp.tolist()
    assert [got[i][2] for i in range(len(x))] == (comp == np.arange(len(x))).tolist()


def test_embedding_links_between_saturated_clusters(spark):
    rng = np.random.default_rng(5)
    base = np.zeros((2, 32))
    base[0, 0], base[1, :2] = 1, (0.965, np.sqrt(1 - 0.965**2))
    x = np.concatenate([c + rng.normal(0, 0.004, (130, 32)) for c in base] + [rng.normal(0, 1, (100, 32))])
    n, _ = links_of(x, 0.95)
    assert (n[:260] > 2 * embedding_dedup.NEIGHBOURS * 2**embedding_dedup.MAX_DOUBLINGS).all()  # more than any list holds
    check_links(spark, x[rng.permutation(len(x))], min_recall=0.0)  # whatever the audit says


def hot_group_and_pairs():
    rng = np.random.default_rng(6)
    pairs = np.repeat(rng.normal(0, 1, (60, 32)), 2, axis=0) + rng.normal(0, 0.01, (120, 32))
    return np.concatenate([rng.normal(0, 1, 32) + rng.normal(0, 0.02, (150, 32)), pairs])


def test_embedding_audit_sees_pairs_beside_a_hot_group(spark):
    x = hot_group_and_pairs()
    n, comp = links_of(x, 0.95)
    assert (n[:150] == 149).all() and (n[150:] == 1).all()
    nodes = spark.createDataFrame([(i, bytearray(v.tobytes()), 1, int(comp[i]) if i < 150 else i) for i, v in enumerate(x)],
                                  "vec_id long, key binary, copies long, component long")
    found = spark.createDataFrame([(i, int(n[i])) for i in range(150)], "vec_id long, n long")  # no pair was found
    assert embedding_dedup.audit(nodes, found, 0.95) < 0.1
    whole = spark.createDataFrame([(i, int(c)) for i, c in enumerate(n)], "vec_id long, n long")
    assert embedding_dedup.audit(nodes, whole, 0.95) == 1.0


def test_embedding_exact_rest_after_the_last_doubling(spark, monkeypatch):
    start = embedding_dedup.start_edges
    monkeypatch.setattr(embedding_dedup, "start_edges", lambda reps, k: start(reps, k).where("u % 7 = 0 and v % 7 = 0"))
    monkeypatch.setattr(embedding_dedup, "MAX_ROUNDS", 0)
    monkeypatch.setattr(embedding_dedup, "MAX_DOUBLINGS", 0)
    check_links(spark, hot_group_and_pairs())


def test_suffix_dedup_deals_the_strings_of_a_frequent_line_apart(spark, monkeypatch):
    rng = np.random.default_rng(7)
    word = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    line, passage = "All rights are reserved here. ", word(90)
    texts = [word(80) + (line if i % 3 == 0 else "") + word(60) + (passage if i % 10 == 0 else "") for i in range(600)]
    texts += [texts[3], texts[9][40:], texts[0]]
    monkeypatch.setattr(suffix_dedup, "HOT", 50)
    largest = spark.sparkContext.accumulator(0)
    add, whole = largest.add, suffix_dedup.smallest_owner

    def watched(runs, owner, length):
        add(sum(len(r) > length for r in runs if line[:24].encode() in r or line[3:27].encode() in r))
        return whole(runs, owner, length)

    monkeypatch.setattr(suffix_dedup, "smallest_owner", watched)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(df).collect()}
    first, expected = {}, []
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for at in range(len(t) - 49):
            if first.setdefault(t[at:at + 50], i) != i:
                gone[at:at + 50] = True
        expected.append(int(gone.sum()))
    assert [got[i] for i in range(len(texts))] == expected and sum(e > 0 for e in expected) > 10
    assert largest.value < 50  # hardly any run of the line is kept whole


def test_suffix_dedup_sorts_a_few_runs_at_a_time(spark, monkeypatch):
    """Lines that come twice among other neighbours: many minimisers, each with several runs, never sorted all at once."""
    rng = np.random.default_rng(8)
    lines = rng.integers(97, 123, (20000, 60), dtype=np.uint8)
    texts = ["".join((a * 20, bytes(x).decode(), a * 20)) for a in "12" for x in lines]
    calls = spark.sparkContext.accumulator(0)
    over = spark.sparkContext.accumulator(0)
    add, add_over, whole = calls.add, over.add, suffix_dedup.smallest_owner

    def watched(runs, owner, length):
        add(1)
        add_over(sum(map(len, runs)) > 400_000)
        return whole(runs, owner, length)

    monkeypatch.setattr(suffix_dedup, "smallest_owner", watched)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = dict(suffix_dedup.remove_repeats(df).select("doc_id", "n_removed").collect())
    assert {got[i] for i in range(1, 20000)} == {0} and {got[i] for i in range(20001, 40000)} == {60}
    assert calls.value > 0 and over.value == 0


def test_suffix_dedup_merges_touching_intervals_of_one_text():
    rng = np.random.default_rng(3)
    doc, key = rng.integers(0, 5, 300), rng.integers(-2, 2, 300)
    a = rng.integers(0, 900, 300)
    z = a + rng.integers(1, 12, 300)
    covered: dict[tuple[int, int], set[int]] = {}
    for d, k, x, y in zip(doc.tolist(), key.tolist(), a.tolist(), z.tolist(), strict=True):
        covered.setdefault((d, k), set()).update(range(x, y))
    got: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for d, k, x, y in zip(*(c.tolist() for c in suffix_dedup.merged(doc, key, a, z)), strict=True):
        got.setdefault((d, k), []).append((x, y))
    assert {t: {i for x, y in spans for i in range(x, y)} for t, spans in got.items()} == covered
    assert all(y < x for spans in got.values() for (_, y), (x, _) in zip(spans, spans[1:], strict=False))
    assert [len(c) for c in suffix_dedup.merged(*[np.zeros(0, np.int64)] * 4)] == [0] * 4


def test_suffix_dedup_string_hashes_and_starts():
    rng = np.random.default_rng(4)
    raw = rng.integers(97, 99, 400).astype(np.uint8)
    at, run = suffix_dedup.starts_within(np.array([0, 200]), np.array([60, 251]), 50)
    assert at.tolist() == [*range(11), 200, 201] and run.tolist() == [0] * 11 + [1] * 2
    every = np.arange(len(raw) - 9)
    h = suffix_dedup.string_hashes(raw, every, 10)
    names = {}
    for i, x in zip(every.tolist(), h.tolist(), strict=True):
        assert names.setdefault(raw[i:i + 10].tobytes(), x) == x
    assert len(set(h.tolist())) == len(names)


def test_suffix_dedup_copies_of_one_batch(spark):
    """Copies in one batch are judged there; repeated rows of the smallest document are no copies of it."""
    text = "".join(chr(97 + i * i % 23) for i in range(40)) + " and a tail that is long enough to be cut"
    rows = [(5, text), (3, text), (3, text), (9, text + " more"), (4, "x" * 30 + text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r["doc_id"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(df).collect())
    n = len(text)
    assert got == [(3, 0, 0), (3, 0, 0), (4, n, 1), (5, n, 1), (9, n, 1)]


def test_written_tables_leave_no_shuffle_files(spark):
    """Lineage cuts read their tables again, never the shuffles that made them."""
    from labelq.llm.common import SHUFFLE_SETTING, materialize

    def shuffles() -> set:
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    before, setting = shuffles(), spark.conf.get(SHUFFLE_SETTING, None)
    out = materialize(spark.range(1000).groupBy(F.col("id") % 10).count().repartition(3), "shuffle-test")
    assert not shuffles() - before
    assert spark.conf.get(SHUFFLE_SETTING, None) == setting
    assert sorted(map(tuple, out.collect())) == [(i, 100) for i in range(10)]


@pytest.mark.parametrize("bits", [16, 18])
def test_sketch_counts(spark, bits):
    """Buckets over and under 255, added from several tasks."""
    from labelq.llm.ngram_jaccard import Shingler, sketch
    import pyarrow as pa

    texts = ["a b c"] * 400 + [f"x{i} y{i % 7} z q" for i in range(300)] + [None, ""]
    got = sketch(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), 3, bits)
    want = np.zeros(1 << bits, np.int64)
    for s in Shingler(3)(pa.array(texts)):
        np.add.at(want, (s >> np.uint64(64 - bits)).astype(np.int64), 1)
    assert (got == np.minimum(np.round(8 * np.log2(np.maximum(want, 1))), 255)).all()
