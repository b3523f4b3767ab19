"""Each operator against a brute-force version on small frames with nulls, empty and long texts, repeated rows,
extra columns of clashing names, and on empty tables."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from labelq.llm import (
    embedding_dedup,
    licenses,
    mixing,
    ngram_jaccard,
    quality_knn,
    quality_rules,
    sentencepiece_bpe,
    suffix_dedup,
    toxicity_pu,
    warc_fixity,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _t string, size long, key string, component long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
MODEL = sentencepiece_bpe.load_model(public_tokenizers.path("piece_bpe_32k.model"))


def rows(texts, start=0):
    return [(start + i, t, "en", None if i % 7 == 3 else f"s{i % 3}", 1, "x", 2, "k", 3) for i, t in enumerate(texts)]


def corpus(n=60, seed=1):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choice(WORDS) + str(rnd.randint(0, 40)) for _ in range(rnd.randint(12, 80))) for _ in range(n)]
    passage = " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 400)) for _ in range(60))
    edited = [t.replace(t.split()[3], "Changed", 1) for t in base[:10]]
    return [*base, *edited, base[0], base[0], None, "", " \t\n", "one two", "one two", f"é {passage} ü", f"{base[5]} {passage}", "word " * 30000, "ONE two"]


@pytest.fixture(scope="module")
def docs(spark):
    data = rows(corpus()) + [(None, "no id " * 20, "en", "s0", 1, "x", 2, "k", 3)]
    return data, spark.createDataFrame(data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return [w for w in re.split("[\x20\x09-\x0D]+", text or "") if w]


def test_license_scan(spark, docs):
    known = licenses.registry(spark)
    texts = ["Released under the MIT Licence!", "Copyright 2020 A\nreleased  under the mit license", "x\nLicensed under CC BY-NC 4.0.\ny", None, "", "copyright me"]
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows(texts), SCHEMA), known).collect()}
    assert [got[i]["license_id"] for i in range(6)] == ["MIT-notice", "MIT-notice", None, None, None, None]
    assert got[2]["notices"] == ["CC-BY-NC-4.0-notice"] and got[3]["digest"] is None and got[5]["digest"] is None
    assert licenses.license_scan(docs[1], known).count() == len(docs[0])
    assert licenses.license_scan(empty(spark), known).count() == 0


def test_quality_cascade(spark, docs):
    def brute(text):
        w = split(text)
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        seen = {g for g in grams if grams.count(g) > 1} if len(grams) < 200 else set(grams)
        covered = {i + k for i, g in enumerate(grams) if g in seen for k in range(5)}
        lines = [x for x in (text or "").split("\n") if split(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)

    data, df = docs
    order = quality_rules.plan_cascade(df, quality_rules.default_rules())
    assert {r.name for r in order} == {r.name for r in quality_rules.default_rules()}
    out = quality_rules.base_metrics(df).withColumn("kept", quality_rules.verdict(order))
    expected = sorted((r[0] if r[0] is not None else -1, *brute(r[1])) for r in data)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
                 for r in out.collect())
    assert got == expected
    assert out.where("base_failed and kept").count() == 0 and out.where("kept").count() > 50
    quality_rules.plan_cascade(empty(spark), quality_rules.default_rules())


def test_mixing(spark, docs):
    data, df = docs
    out = mixing.mix_plan(df).collect()
    assert len(out) == len(data)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_plan(df.repartition(5)).collect()))
    size, taken, target = {}, {}, {}
    for r in out:
        assert 0 <= r["copies"] <= 2
        key = (r["source_size"], r["target"])
        size[key] = r["source_size"]
        taken[key] = taken.get(key, 0) + r["copies"] * r["size"]
    total = sum(len(split(r[1])) for r in data)
    assert abs(sum(k[1] for k in taken) - min(1.5 * total, 2 * total)) < 1e-6 * total
    biggest = max(len(split(r[1])) for r in data)
    for key, words in taken.items():
        assert key[1] <= 2 * key[0] + 1e-6 and abs(words - key[1]) <= biggest
    assert mixing.mix_plan(empty(spark)).count() == 0


def test_sentencepiece(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    codec = sentencepiece_bpe.Codec(MODEL)
    rnd = random.Random(3)
    odd = ["".join(rnd.choice("abcdeé 中文▁ \n\t<0x41></s>") for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    for t in [*odd, "a" * 3000, " " * 500, "\U0001F600 x\u0000y", *[r[1] or "" for r in docs[0]]]:
        ids = sp.encode(t, add_eos=True)
        assert codec.encode(t) == ids and codec.decode(ids) == sp.decode(ids)
    got = {r["doc_id"]: r for r in sentencepiece_bpe.encode_column(docs[1], MODEL, keep_ids=True).collect()}
    for i, t, *_ in docs[0]:
        ids = sp.encode(t or "", add_eos=True)
        assert got[i]["ids"] == ids and got[i]["decoded"] == sp.decode(ids) and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert sentencepiece_bpe.encode_column(empty(spark), MODEL).count() == 0


def test_warc_fixity(spark):
    data = [("a", i * 997, f"record {i}") for i in range(300)] + [("b", 0, None), ("b", 5, "x"), ("b", 5, "x"), (None, None, "y")]
    other = [r for r in data if r[1] != 997 * 7] + [("a", 12345678, "new"), ("c", 1, "z")]
    other = [("a", o, "damaged") if a == "a" and o == 997 * 50 else (a, o, c) for a, o, c in other]
    schema = "archive string, offset long, content string"
    frame = lambda x: warc_fixity.leaves(spark.createDataFrame(x, schema))
    got = {(r["archive"], r["offset"], r["status"]) for r in warc_fixity.audit(frame(data), frame(other)).collect()}
    assert got == {("a", 997 * 7, "missing"), ("a", 997 * 50, "altered"), ("a", 12345678, "added"), ("c", 1, "added")}
    assert warc_fixity.audit(frame(data), frame(data)).count() == 0
    assert warc_fixity.audit(frame([]), frame([])).count() == 0
    assert warc_fixity.audit(frame(data), frame([])).count() == 303


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_jaccard(spark, docs, n, percent):
    data, df = docs
    sets = {}
    for i, t, *_ in data:
        w = split(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.ngram_components(df, n, percent).collect()}
    assert got == {i: (len(s), None if i is None else find(i)) for i, s in sets.items()}
    assert any(find(i) != i for i in parent)
    assert ngram_jaccard.ngram_components(empty(spark), n, percent).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = rng.integers(1, 4, rng.integers(0, 70))
        values = s.tolist()
        assert suffix_dedup.suffix_array(s).tolist() == sorted(range(len(values)), key=lambda i: values[i:])


def test_suffix_dedup(spark, docs):
    data, df = docs
    seen, expected = set(), {}
    for i, t, *_ in sorted((r for r in data if r[0] is not None), key=lambda r: r[0]):
        raw = (t or "").encode()
        covered = bytearray(len(raw))
        own = [raw[j:j + 50] for j in range(len(raw) - 49)]
        for j, w in enumerate(own):
            if w in seen:
                covered[j:j + 50] = b"\1" * 50
        seen.update(own)
        spans = sum(1 for j in range(len(raw)) if covered[j] and (j == 0 or not covered[j - 1]))
        kept = bytes(x for x, c in zip(raw, covered, strict=True) if not c)
        expected[i] = (len(raw), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got.pop(None)[1] == 0
    assert got == expected
    kept = suffix_dedup.remove_repeats(df, keep_text=True)
    assert set(df.columns) < set(kept.columns) and kept.count() == len(data)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_embedding_near_duplicates(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((120, 16))
    vectors = [*base, *(base[:20] + 0.01 * rng.standard_normal((20, 16))), base[0], 3 * base[0], *(base[1] + 0.01 * rng.standard_normal((40, 16)))]
    data = [(i, v.tolist(), 1, "x") for i, v in enumerate(vectors)]
    n = len(data)
    data += [(n, None, 1, "x"), (n + 1, [0.0] * 16, 1, "x"), (n + 2, [float("nan")] + [1.0] * 15, 1, "x"), (n + 3, [1.0] * 3, 1, "x"),
             (n + 4, [None] + [1.0] * 15, 1, "x"), (n + 5, [], 1, "x"), (None, base[0].tolist(), 1, "x")]
    schema = "vec_id long, embedding array<double>, label int, codes string"
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(data, schema)).collect()}
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    comp = np.arange(n)
    for _ in range(n):
        comp = np.array([min([comp[i], *comp[link[i]]]) for i in range(n)])
    assert [got[i]["n_links"] for i in range(n)] == link.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(n)] == comp.tolist()
    for i in range(n, n + 6):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert got[None]["component_id"] is None
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def labelled(spark, bad):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(20, 60))) for _ in range(400)]
    y = [i % 4 == 0 for i in range(400)]
    data = rows([bad(t) if b else t for t, b in zip(texts, y, strict=True)]) + [(None, "alpha", "en", "s", 1, "x", 2, "k", 3), (500, None, "en", "s", 1, "x", 2, "k", 3)]
    labels = spark.createDataFrame([(i, int(not b), int(b)) for i, b in enumerate(y) if i % 2 == 0] + [(501, None, None)], "doc_id long, quality int, toxic int")
    return spark.createDataFrame(data, SCHEMA), labels, y


def test_toxicity(spark):
    df, labels, y = labelled(spark, lambda t: t + " scum moron")
    out = {r["doc_id"]: r["score"] for r in toxicity_pu.score(df, toxicity_pu.train(df, labels)).collect()}
    assert np.mean([(out[i] >= 0.7) == b for i, b in enumerate(y)]) > 0.95
    assert 0 <= out[500] < 0.7 and out[None] < 0.7
    none = toxicity_pu.train(df, labels.where("toxic = 0"))
    assert max(r["score"] for r in toxicity_pu.score(df, none).collect()) < 0.01
    assert toxicity_pu.score(empty(spark), none).count() == 0


def test_quality_knn(spark):
    df, labels, y = labelled(spark, lambda t: t.upper().replace(" ", "!! "))
    out = {r["doc_id"]: r["score"] for r in quality_knn.score(df, quality_knn.fit(df, labels)).collect()}
    assert np.mean([(out[i] < 0.7) == b for i, b in enumerate(y)]) > 0.95
    assert out[500] == pytest.approx(0.5, abs=0.1)
    none = quality_knn.fit(df, labels.where("quality > 5"))
    assert {r["score"] for r in quality_knn.score(df, none).collect()} == {0.5}
    assert quality_knn.score(empty(spark), quality_knn.fit(empty(spark), labels)).count() == 0


def test_words_are_encoded_once_whatever_marks_follow():
    c = sentencepiece_bpe.Codec(sentencepiece_bpe.load_model(public_tokenizers.path("piece_bpe_32k.model")))
    done, tokens = [], c.tokens
    c.tokens = lambda text: done.append(text) or tokens(text)
    want = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = "Qzxhaus Qzxhaus, Qzxhaus. (Qzxhaus) Qzxhaus.\nQzxhaus x².y a_b"
    assert c.encode(text) == want.encode(text, add_eos=True)
    assert done.count("\u2581Qzxhaus") == 1 and not any("Qzxhaus" in d and d.strip("\u2581Qzxhaus") for d in done)


def test_pair_check_equals_the_merges():
    c = sentencepiece_bpe.Codec(sentencepiece_bpe.load_model(public_tokenizers.path("piece_bpe_32k.model")))
    r = random.Random(6)
    for ch in "\U0001f600\u0e01":
        if ch not in c.token:
            c.add(ch)
    numbers = [r.randrange(len(c.string)) for _ in range(150)] + [len(c.string) - 1] + [c.token[x] for x in ("a", "e", "aa", "\u2581") if x in c.token]
    for a in numbers:
        for b in numbers:
            pair = [c.string[a], c.string[b]]
            assert c.stays(a, b) == (c.merge("".join(pair)) == pair), pair
