"""from the tags of an extractor to slots (when / where / who), by a table of rules.

A rule belongs to an extractor and names a slot, a tag (a label, or the leading parts of a part-of-speech path, ``*`` for any part), words
that alone match or never match, and bounds on the term. Rules are tried by priority. An ``exclusive`` extractor gives a term the slot
of its first matching rule; another gives it every slot that has a matching rule, once.

Rules are few (checked) and compile into one expression, so mapping is a projection: no join, no shuffle, and the priority needs no window.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More rules than this are a join's work, not an expression's.
MAX_RULES = 500


@dataclass(frozen=True)
class TagRule:
    extractor: str
    slot: str
    priority: int
    tag: str = ""
    words: tuple[str, ...] = ()
    not_words: tuple[str, ...] = ()
    min_chars: int = 1
    max_chars: int | None = None
    digits: bool = True


# Labels of a named-entity model, its noise filter included; a label may be in one slot only.
_GINZA = {"when": ["DATE", "TIME", "EVENT"], "where": ["LOC", "FACILITY", "GPE"], "who": ["PERSON", "NORP", "ORG", "PRODUCT"]}
# Labels of a second model, tried in this order.
_HF = [("when", ["DATE", "TIME", "TIM"]), ("where", ["LOC", "GPE", "FAC"]), ("who", ["PER", "PSN"]), ("who", ["ORG"])]
# Part-of-speech paths of a morphological analyser, and plain words, by slot.
_PLACES = ("学校", "家", "公園", "病院", "店", "部屋")
_THINGS = ("これ", "それ", "あれ", "どれ", "ここ", "そこ", "あそこ", "どこ")
_ROLES = ("友達", "先生", "母", "父", "子供", "上司", "部下")

RULES: tuple[TagRule, ...] = (
    *[TagRule("ginza", slot, i, tag, max_chars=19, digits=False) for i, (slot, tags) in enumerate(_GINZA.items()) for tag in tags],
    *[TagRule("hf", slot, i, tag) for i, (slot, tags) in enumerate(_HF) for tag in tags],
    TagRule("sudachi", "when", 0, "名詞,時相名詞", min_chars=2),
    TagRule("sudachi", "when", 1, "名詞,普通名詞,副詞可能", min_chars=2),
    TagRule("sudachi", "where", 2, "名詞,固有名詞,地名"),
    TagRule("sudachi", "where", 3, "名詞", words=_PLACES),
    TagRule("sudachi", "who", 4, "名詞,固有名詞,人名"),
    TagRule("sudachi", "who", 5, "代名詞", not_words=_THINGS),
    TagRule("sudachi", "who", 6, words=_ROLES),
)
EXCLUSIVE = frozenset({"hf"})


def rules_from(table: DataFrame) -> list[TagRule]:
    """Rules kept as a table (extractor, slot, priority, tag, words, not_words, min_chars, max_chars, digits); at most MAX_RULES."""
    rows = table.limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} tag rules")
    return [TagRule(r.extractor, r.slot, r.priority, r.tag or "", tuple(r.words or ()), tuple(r.not_words or ()), r.min_chars or 1, r.max_chars,
                    True if r.digits is None else r.digits) for r in rows]


def _matches(rule: TagRule, extractor: Column, tag: Column, term: Column, is_digits: Column) -> Column:
    conditions = [extractor == rule.extractor, F.length(term) >= rule.min_chars]
    if rule.tag:
        parts = F.split(tag, ",")
        conditions += [F.coalesce(F.get(parts, F.lit(i)) == part, F.lit(False)) for i, part in enumerate(rule.tag.split(",")) if part != "*"]
    if rule.words:
        conditions.append(term.isin(*rule.words))
    if rule.not_words:
        conditions.append(~term.isin(*rule.not_words))
    if rule.max_chars is not None:
        conditions.append(F.length(term) <= rule.max_chars)
    if not rule.digits:
        conditions.append(~is_digits)
    return F.coalesce(reduce(and_, conditions), F.lit(False))


def slots_of(rules: Iterable[TagRule], extractor: Column, tag: Column, term: Column, is_digits: Column, exclusive: Iterable[str] = EXCLUSIVE) -> Column:
    """Array of the slots of a term, in order of their first matching rule; empty when none matches."""
    ordered = sorted(rules, key=lambda r: r.priority)
    if len(ordered) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} tag rules")
    found = F.array(*[F.when(_matches(r, extractor, tag, term, is_digits), F.lit(r.slot)) for r in ordered]) if ordered else F.array().cast("array<string>")
    slots = F.array_distinct(F.filter(found, lambda s: s.isNotNull()))
    alone = list(exclusive)
    return F.when(extractor.isin(*alone), F.slice(slots, 1, 1)).otherwise(slots) if alone else slots


def map_tags(entities: DataFrame, is_digits: Column, rules: Sequence[TagRule] = RULES, exclusive: Iterable[str] = EXCLUSIVE) -> DataFrame:
    """A row per slot of every row of ``entities`` (extractor, tag, term, ...), with ``slot``; terms without a slot are dropped."""
    slots = slots_of(rules, F.col("extractor"), F.col("tag"), F.col("term"), is_digits, exclusive)
    return entities.withColumn("slot", F.explode(slots))
