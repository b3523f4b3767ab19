"""Quality rules as a short-circuit cascade (DataFrame functions only).

``base_metrics`` adds the word and line counts that the rules read; ``RULES`` are cheap or
costly rejections over them.  ``plan_cascade`` times every rule on a sample and counts what it rejects there,
and orders the rules by rejections per second of cost; ``verdict`` chains them in that order with
CASE WHEN, so a rejected text never reaches the later, dearer rules.  The order changes the cost
only: a text is kept when no rule rejects it, whatever the order.

Defined results: null, empty and blank texts have zero counts and fail the base test; repeated
rows are judged one by one; a null doc_id stays null; an empty table gives an empty result (the
rules keep their given order); extra columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelq.llm.common import materialize, read, words

#: Rows of the sample that orders the rules (about; taken by a hash of the row).
SAMPLE_ROWS = 2000
#: Words per repeated window.
WINDOW = 5
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A named rejection over ``text`` and the columns of ``base_metrics``."""

    name: str
    rejects: Column


def default_rules() -> list[Rule]:
    n, t = F.col("n_words"), F.col("text")
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    upper = F.length(F.regexp_replace(t, r"[^\p{Lu}]+", ""))
    return [
        Rule("mean_word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("duplicate_lines", 10 * F.col("n_dup_lines") > 4 * F.col("n_lines")),
        Rule("shouting", 10 * upper > 6 * letters),
        Rule("few_letters", 2 * letters < F.col("word_chars")),
        Rule("exclamations", 5 * F.regexp_count(t, F.lit("[!?]{2,}")) > n),
    ]


def _repeat_words(w: Column) -> Column:
    """Words of the word array ``w`` inside a window of WINDOW words that occurs twice or more.

    64-bit hashes of all windows are compared first; texts in which they all differ, the usual
    case, are done.  For the rest the hashes are sorted with their positions, equal neighbours
    mark repeated windows, and the distinct positions they cover are counted.  (Two different windows of one
    text share a hash with a chance below 1e-10 even at 20,000 words.)"""

    def bind(value: Column, f):
        # A one-element transform evaluates ``value`` once for all its uses in ``f``, also after
        # the optimizer has moved the expression below a filter.
        return F.get(F.transform(F.array(value), f), F.lit(0))

    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(WINDOW)]))

    def repeated(g: Column) -> Column:
        same = F.filter(g, lambda x, k: (F.get(g, k - 1)["h"] == x["h"]) | (F.get(g, k + 1)["h"] == x["h"]))
        covered = F.flatten(F.transform(same, lambda x: F.array(*[x["i"] + k for k in range(WINDOW)])))
        return F.size(F.array_distinct(covered))

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(placed, repeated))

    return bind(w, lambda w: F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(bind(hashes(w), count))).cast("long")


def base_metrics(docs: DataFrame) -> DataFrame:
    """``docs`` columns doc_id and text with n_words, word_chars, n_symbols, n_lines (with a word),
    n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\u000b\f\r"))) > 0)
    rows = docs.select("doc_id", text.alias("text"), words(F.col("text")).alias("_w"), lines.alias("_l"))
    rows = rows.select(
        "doc_id", "text",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).alias("n_repeat_words"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def plan_cascade(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` by rejected rows per second on a sample of about ``sample_rows`` rows.

    The cost of a rule is the time of one aggregate over the sample less that of an empty rule.  Only the
    order of evaluation depends on it."""
    every = max(1, docs.count() // sample_rows)
    picked = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0)
    sample = materialize(base_metrics(picked).coalesce(2), "rules-sample").where(~F.col("base_failed"))

    def timed(rule: Column) -> tuple[float, int]:
        began = time.perf_counter()
        hits = sample.agg(F.count_if(rule).alias("n")).first()["n"]
        return time.perf_counter() - began, hits

    timed(F.length("text") < 0)  # compiles the scan
    floor = min(timed(F.length("text") < 0)[0] for _ in range(2))
    scored = []
    for at, rule in enumerate(rules):
        cost, hits = min(timed(rule.rejects) for _ in range(2))
        scored.append((-(hits + 1e-3) / max(cost - floor, 1e-3), at, rule))
    return [rule for _, _, rule in sorted(scored, key=lambda x: x[:2])]


def verdict(rules: Sequence[Rule]) -> Column:
    """True when neither the base test nor a rule rejects the row; later rules are not evaluated for rejected rows."""
    chain = F.when(F.col("base_failed"), F.lit(False))
    for rule in rules:
        chain = chain.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(False))
    return chain.otherwise(F.lit(True))


def op9_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base_failed and the cascade's verdict of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ordered = plan_cascade(docs, default_rules())
    return base_metrics(docs).withColumn("kept", verdict(ordered)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, list_aggregate(w[i:i+4], 'string_agg', ' ') AS gram
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS p FROM r, (SELECT unnest(range(5)) AS k)) GROUP BY doc_id),
m AS (SELECT w.doc_id, text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) AS n_lines,
        len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
        length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS upper_letters,
        len(regexp_extract_all(text, '[!?]{2,}')) AS exclaims
      FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_symbols > n_words
       OR 10 * n_dup_lines > 4 * n_lines OR 10 * upper_letters > 6 * letters OR 2 * letters < word_chars OR 5 * exclaims > n_words) AS kept
FROM b"""

QUERIES = {"op9_quality_cascade": op9_quality_cascade}
ORACLE_SQL = {"op9_quality_cascade": _ORACLE}
