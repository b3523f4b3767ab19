"""Hard-negative mining, ranked lexical search and decontamination against brute-force versions on small frames with nulls, empty and
very long texts, ties, repeated rows and extra columns of clashing names, with blocks and passes small enough to be several."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelq.llm import decontaminate, hard_negatives, lexical_search, wordbytes

DOCS = "doc_id long, text string, n_words long, items string, rank int, terms string, _text string"
ITEMS = "item_id long, text string, window string, doc_id long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def docs_and_items(seed=4):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "中文", "ñu", "X1"]
    text = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(rnd.randint(3, 25)), "w", i) for i in range(12)]
    items += [(3, text(12), "w", 1), (20, items[0][1], "w", 1), (21, "", "w", 1), (22, None, "w", 1), (23, "?!", "w", 1), (None, text(11), "w", 1), (24, "nowhere seen", "w", 1)]
    texts = [text(rnd.randint(0, 60)) for _ in range(150)]
    for k, (_, t, *_) in enumerate(items):
        texts.append(f"{texts[k]}. {(t or '').upper().replace('É', 'É')} tail {texts[k + 1]}")
    texts += ["", None, " \t", texts[0], texts[0], f"{items[1][1]} {items[1][1]}", "w1 " * 40000 + items[2][1]]
    rows = [(i, t, 1, "x", 2, "y", "z") for i, t in enumerate(texts)] + [(None, items[4][1], 1, "x", 2, "y", "z"), (5, texts[5], 1, "x", 2, "y", "z"), (6, "other w1 w2", 1, "x", 2, "y", "z")]
    return rows, items


@pytest.fixture(scope="module")
def frames(spark):
    rows, items = docs_and_items()
    return rows, items, spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)


def as_key(x):
    return (x is None, x)


def test_word_bytes():
    text = "Añ-B2中 c\U0001F600  D"
    data = wordbytes.normalised(text)
    first, end = wordbytes.word_places(data)
    places = wordbytes.character_places(text, np.stack([first, end], 1))
    assert [lowered(text[a:b]) for a, b in places] == WORD.findall(lowered(text)) == [w.decode() for w in data.split()]


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 3000])
def test_decontamination(frames, block_bytes):
    rows, items, docs, benchmark = frames
    patterns = defaultdict(set)
    for i, t, *_ in items:
        w = WORD.findall(lowered(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            patterns[tuple(w[k:k + 10])].add(i)
    sizes = {len(p) for p in patterns}
    expected = []
    for i, t, *_ in rows:
        w, hit, found = WORD.findall(lowered(t)), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                got = patterns.get(tuple(w[k:k + size]))
                if got:
                    hit.update(range(k, k + size))
                    found |= got - {None}
        expected.append((i, len(w), len(hit), sorted(found)))
    out = decontaminate.find_contamination(docs, benchmark, ("doc_id", "rank"), block_bytes=block_bytes).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in out), key=lambda x: (as_key(x[0]), x[1:])) \
        == sorted(expected, key=lambda x: (as_key(x[0]), x[1:]))
    texts = {r[0]: r[1] for r in rows if r[0] not in (5, 6)}
    for r in out:
        if r["doc_id"] in texts:
            spans = [texts[r["doc_id"]][a:b] for a, b in r["spans"]]
            assert sum(len(WORD.findall(lowered(s))) for s in spans) == r["n_hit"]
            assert all(WORD.match(lowered(s)) and WORD.match(lowered(s[-1])) for s in spans)
    assert any(len(r["items"]) > 1 for r in out) and any(r["n_hit"] == 0 for r in out)


def test_decontamination_of_empty_tables(frames):
    _, _, docs, benchmark = frames
    assert decontaminate.find_contamination(docs.where("false"), benchmark).count() == 0
    assert decontaminate.find_contamination(docs, benchmark.where("false")).where("n_hit > 0 or size(items) > 0").count() == 0


@pytest.mark.parametrize(("k", "limits"), [(50, {}), (7, {"pass_bytes": 250, "block_terms": 12, "cells": 600})])
def test_lexical_search(frames, k, limits):
    rows, items, docs, benchmark = frames
    counts = [(r[0], Counter(WORD.findall(lowered(r[1])))) for r in rows]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = defaultdict(set)
    for i, t, *_ in items:
        wanted[i] |= set(WORD.findall(lowered(t)))
    expected = []
    for item, terms in wanted.items():
        scored = []
        for i, c in counts:
            m = 100 - 50 + (50 * c.total() * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, as_key(i)))
        expected += [(as_key(item), rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k])]
    out = lexical_search.ranked(docs, benchmark, k, **limits)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((as_key(r[0]), r[1], as_key(r[2]), r[3]) for r in out.collect()) == sorted(expected)


def test_lexical_search_prunes_and_survives_empty_tables(spark, frames):
    _, _, docs, benchmark = frames
    assert lexical_search.ranked(docs.where("false"), benchmark).count() == 0
    assert lexical_search.ranked(docs, benchmark.where("false")).count() == 0
    rng = np.random.default_rng(1)
    tf = (rng.random((1000, 30)) < np.linspace(0.9, 0.01, 30)) * rng.integers(1, 4, (1000, 30))
    m = rng.integers(50, 300, 1000)
    tree, best = lexical_search.FPTree(tf.astype(np.int32), m), lexical_search.Best(5)
    terms, weights = np.array([2, 20, 28]), np.array([100, 3000, 5000])
    visited = tree.search(terms, weights, best, np.arange(1000), np.zeros(1000, bool))
    scores = lexical_search.impact(tf[:, terms].astype(np.int64), m[:, None]) @ weights
    assert best.ids.tolist() == np.lexsort((np.arange(1000), -scores))[:5].tolist() and visited < len(tree.lo)


def brute_negatives(rows):
    kept = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for a, la, va in kept:
        if a % 100:
            continue
        score = lambda v: sum(x * y for x, y in zip(va, v, strict=True))  # noqa: B023, E731
        same = sorted(((-score(v), i) for i, lab, v in kept if lab == la and i != a and len(v) == len(va)))[:5]
        others = sorted(((-score(v), i) for i, lab, v in kept if lab != la and len(v) == len(va)))
        for p, pid in same:
            window = [(s, i) for s, i in others if 80 * -p <= 100 * -s <= 100 * -p][:5]
            out += [(a, pid, k + 1, i, -p, -s) for k, (s, i) in enumerate(window)]
    return sorted(out)


@pytest.mark.parametrize("anchor_bytes", [hard_negatives.ANCHOR_BYTES, 2000])
def test_hard_negatives(spark, anchor_bytes):
    rng = np.random.default_rng(9)
    vectors = rng.standard_normal((1500, 6)) * 0.3
    vectors[200:500] = vectors[100]  # ties: many copies
    vectors[600:700] = np.round(vectors[600:700])
    rows = [(i, v.tolist(), int(rng.integers(0, 4))) for i, v in enumerate(vectors)]
    rows += [(1600, None, 1), (None, [1.0] * 6, 1), (1700, [1.0] * 6, None), (1800, [1.0, None, 1.0, 1.0, 1.0, 1.0], 2), (1900, [float("inf")] * 6, 2),
             (2000, [0.5, 0.5], 2), (2001, [0.5, 0.4], 2), (2002, [0.4, 0.5], 3), (2100, [], 1), (2101, [], 1), (2102, [], 2), (3000, [0.0] * 6, 1),
             rows[100], rows[100], (100, vectors[7].tolist(), 3), rows[301], (4000, [float(1e6)] * 6, 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, vector string, rank int").repartition(3)
    out = hard_negatives.hard_negatives(hard_negatives.quantised(df), F.col("vec_id") % 100 == 0, anchor_bytes=anchor_bytes)
    expected = brute_negatives(rows)
    assert sorted(map(tuple, out.collect())) == expected and len(expected) > 100
    assert hard_negatives.hard_negatives(hard_negatives.quantised(df.where("false")), F.col("vec_id") % 100 == 0).count() == 0


def test_r_tree_prunes():
    rng = np.random.default_rng(2)
    centres = rng.integers(-200, 200, (40, 8))
    x = np.repeat(centres, 100, 0) + rng.integers(-3, 4, (4000, 8))
    ids = rng.permutation(4000)
    tree = hard_negatives.RTree(x.astype(float), ids)
    asked = x[:20].astype(float)
    top = hard_negatives.Top(asked, np.arange(20) - 100, np.arange(20), np.full(20, hard_negatives._LOWEST + 1), np.full(20, 2**62), 5, False)
    seen, offer = [], top.offer
    top.offer = lambda who, s, rows: (seen.append(len(who)), offer(who, s, rows))
    tree.search(top, np.arange(20))
    scores = asked @ x.T
    assert all(top.row[i].tolist() == ids[np.lexsort((ids, -scores[i]))[:5]].tolist() for i in range(20))
    assert sum(seen) < 20 * (4000 // hard_negatives.LEAF) / 3
