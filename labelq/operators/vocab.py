"""Vocabulary pools.

Keyword extraction is one scan: every rule's ``regexp_extract_all`` goes into one array of
(category, terms) structs, exploded once. Pools stay in long form ``(category, term)``;
distinct is planned as a partial aggregate before the shuffle. Sorted lists per category
are built only at export, and their size is bounded by the rules (each term is one of a
rule's fixed alternatives) or, for model extractors, by the vocabulary.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelq.functions.rules import EXCLUDED_TERMS, KEYWORD_RULES
from labelq.functions.text import col_of, py_strip
from labelq.session import bounded, materialize, ship_package, small_batches
from labelq.sources.io import write_ordered

MAX_TERM_CHARS = 20
# Characters for which Python's str.isdigit() is true (superscripts too), built by rule.
ISDIGIT_CLASS = "[" + "".join(f"\\x{{{c:x}}}" for c in range(sys.maxunicode + 1) if chr(c).isdigit()) + "]"


def all_digits(term) -> F.Column:
    return col_of(term).rlike(f"^{ISDIGIT_CLASS}+$")


def term_ok(term) -> F.Column:
    """F16: non-empty, shorter than 20 characters, not all digits."""
    t = col_of(term)
    return (F.length(t) > 0) & (F.length(t) < MAX_TERM_CHARS) & ~all_digits(t)


_KEYWORD_GROUP = re.compile(r"^\(\^\|\\s\|\[\^[^\]]*\]\)\(([^()\\\[\].*+?{}]*)\)")


def rule_keywords(pattern: str) -> list[str] | None:
    """Keywords of a rule shaped ``(^|\\s|[^...])(kw1|kw2|...)(suffix)``; None for other shapes."""
    m = _KEYWORD_GROUP.match(pattern)
    return m.group(1).split("|") if m else None


def keyword_guard(text, pattern: str):
    """Exact pre-check for a rule: a match needs one of its keywords as a substring, and
    ``contains`` is a plain byte search, far cheaper than trying the alternation at every
    character. None when the rule's shape gives no keyword list."""
    kws = rule_keywords(pattern)
    if not kws:
        return None
    cond = None
    for kw in dict.fromkeys(kws):
        c = text.contains(kw)
        cond = c if cond is None else cond | c
    return cond


_KEYWORD_RULE = re.compile(r"\(\^\|\\s\|\[\^[^\]\\^-]*\]\)\(([^()\\\[\].*+?{}^$]+)\)\(([^()\\\[\].*+?{}^]+)\)")


def rule_characters(pattern: str) -> set[str] | None:
    """Characters of the keywords and endings of a rule shaped ``(^|\\s|[^...])(kw1|kw2|...)(end1|end2|$)``, all beyond ASCII; None for
    other rules."""
    m = _KEYWORD_RULE.fullmatch(pattern)
    parts = [p for p in (m[1] + "|" + m[2]).split("|") if p != "$"] if m else [""]
    found = set("".join(parts))
    return found if all(parts) and min(found) > "\x7f" else None


def squeezed(text, characters: set[str]):
    """``text`` with every run of three or more characters outside the range of ``characters`` cut to its last two. Rules of these characters
    find the same terms in it: a match has one other character at most, which stands before its keyword, and ``$`` follows a keyword only
    where nothing or one line break is left."""
    other = f"[^\\x{{{ord(min(characters)):x}}}-\\x{{{ord(max(characters)):x}}}]"
    return F.regexp_replace(text, F.lit(f"{other}+({other}{{2}})"), F.lit("$1"))


def extract_terms(
    df: DataFrame,
    text_col: str,
    rules: Sequence[tuple[str, str]] = KEYWORD_RULES,
    excluded: dict[str, list[str]] = EXCLUDED_TERMS,
    keep_cols: Sequence[str] = (),
    filter_terms: bool = True,
) -> DataFrame:
    """(keep_cols..., category, term) for every match, group 2 of each rule, stripped; F16 with ``filter_terms`` (for rules
    that find open-ended terms leave it off: it drops terms of 20 characters and more, and digits)."""
    known = [rule_characters(pat) for _, pat in rules]
    if any(known):
        # The rules try every keyword at every character, so they read a text in which only the places they can match are left.
        df = df.select(*dict.fromkeys([*keep_cols, text_col]), squeezed(F.col(text_col), set().union(*filter(None, known))).alias("_squeezed"))
    structs = []
    for (cat, pat), chars in zip(rules, known):
        text = F.col("_squeezed") if chars else F.col(text_col)
        found = F.regexp_extract_all(text, F.lit("(?d)" + pat), 2)
        guard = keyword_guard(text, pat)
        if guard is not None:
            found = F.when(guard, found).otherwise(F.array().cast("array<string>"))
        structs.append(F.struct(F.lit(cat).alias("category"), found.alias("terms")))
    arr = F.array(*structs)
    per_rule = df.select(*keep_cols, F.inline(arr))
    exploded = per_rule.select(*keep_cols, "category", F.explode("terms").alias("term"))
    terms = exploded.withColumn("term", py_strip("term"))
    out = terms.where(term_ok("term") if filter_terms else F.length("term") > 0)
    for cat, words in excluded.items():
        out = out.where(~((F.col("category") == cat) & F.col("term").isin(*words)))
    return out


def vocab_long(terms: DataFrame, *more: DataFrame) -> DataFrame:
    """Distinct (category, term), over one or several term sets."""
    out = terms.select("category", "term")
    for m in more:
        out = out.unionByName(m.select("category", "term"))
    return out.distinct()


MAX_POOL = 1_000_000


def vocab_pools(long: DataFrame, max_terms: int = MAX_POOL) -> DataFrame:
    """A17 / O6 at the JSON edge: sorted unique list and its size per category. A list is one row, so pools are counted first; one
    of more than ``max_terms`` terms is an error: write the long form with :func:`write_pools` instead. The distinct terms are written once,
    so what found them runs once."""
    long = materialize(long.select("category", "term"), "vocab")
    large = long.groupBy("category").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_terms).select("category").collect()
    if large:
        raise ValueError(f"pools of more than {max_terms} terms: {sorted(r[0] for r in large)}")
    return long.groupBy("category").agg(
        F.array_sort(F.collect_set("term")).alias("terms"), F.count(F.lit(1)).alias("size")
    )


def write_pools(long: DataFrame, path: str, fmt: str = "json") -> None:
    """A17 / K3 / O6 for pools of any size: (category, term) rows in files sorted by both, whose names carry the order."""
    write_ordered(long.select("category", "term"), path, ["category", "term"], fmt=fmt)


def regex_extractor(rules: Sequence[tuple[str, str]] = KEYWORD_RULES) -> Callable[[str], list]:
    """Default M10 extractor: the F15 rules in Python, tag = category."""
    compiled = [(cat, re.compile(pat), tuple(dict.fromkeys(rule_keywords(pat) or ()))) for cat, pat in rules]

    def extract(text: str) -> list:
        out = []
        for cat, rx, kws in compiled:
            if kws and not any(kw in text for kw in kws):
                continue  # exact: no keyword, no match
            out.extend((cat, m[1]) for m in rx.findall(text))
        return out

    return extract


def extract_entities(
    df: DataFrame,
    id_col: str,
    text_col: str,
    extractor: Callable[[str], list] | None = None,
    tag_to_slot: dict[str, str] | None = None,
    excluded: dict[str, list[str]] | None = None,
    filter_terms: bool | None = None,
) -> DataFrame:
    """Run an entity extractor per text inside ``mapInPandas``; emit (id, tag, term).

    ``extractor(text) -> [(tag, term)]``; a row whose extraction raises is skipped. Tags
    map to slots through ``tag_to_slot`` (F17); unmapped tags are dropped. Whole texts
    are always used. ``filter_terms`` applies F16 (by default only to the regex fallback, as
    its SQL does); without it only empty terms are dropped.
    """
    filter_terms = extractor is None if filter_terms is None else filter_terms
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)
    if extractor is None:
        # the regex fallback drops its excluded terms, as extract_terms does
        extractor = regex_extractor()
        excluded = EXCLUDED_TERMS if excluded is None else excluded
    src = df.select(id_col, text_col)
    id_field = src.schema[id_col]
    schema = T.StructType([id_field, T.StructField("tag", T.StringType()), T.StructField("term", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, tags, terms = [], [], []
            for i, text in zip(pdf[id_col], pdf[text_col]):
                if text is None:
                    continue
                try:
                    found = extractor(text)
                except Exception:  # noqa: BLE001 - per-row errors are skipped
                    continue
                for tag, term in found:
                    ids.append(i)
                    tags.append(tag)
                    terms.append(term)
            yield pd.DataFrame({id_col: pd.Series(ids, dtype=pdf[id_col].dtype), "tag": pd.Series(tags, dtype=object), "term": pd.Series(terms, dtype=object)})

    ents = src.mapInPandas(bounded(run), schema)
    slot = F.col("tag")
    if tag_to_slot is not None:
        m = None
        for tag, s in tag_to_slot.items():
            m = F.when(F.col("tag") == tag, F.lit(s)) if m is None else m.when(F.col("tag") == tag, F.lit(s))
        slot = m if m is not None else F.lit(None).cast("string")
    out = ents.withColumn("category", slot).withColumn("term", py_strip("term")).where(
        F.col("category").isNotNull() & (term_ok("term") if filter_terms else F.length("term") > 0)
    )
    for cat, words in (excluded or {}).items():
        out = out.where(~((F.col("category") == cat) & F.col("term").isin(*words)))
    return out
