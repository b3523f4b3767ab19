"""Registered queries of the vocabulary, tag mapping and slot operators over items that begin with a scene (``roles.SCENES``), so that every
rule, slot and reply branch has rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelq.functions import parsers as P
from labelq.functions.prompts import SLOTS, slot_prompt
from labelq.functions.rules import stand_in_column, stand_in_scorer
from labelq.operators.scoring import batch_score
from labelq.operators.tags import map_tags
from labelq.operators.vocab import all_digits, extract_entities, extract_terms, vocab_long, vocab_pools
from labelq.plans import roles as R
from labelq.plans.queries import _RESPONSE_FIELD


def scene_terms(spark, sf):
    """F15 + F16: terms of the keyword rules per item."""
    return extract_terms(R.scenes(spark, sf), "text", keep_cols=["doc_id"])


def tagged_words(text: str) -> list:
    """Stand-in for three extractors on one text: (extractor and tag, term) of every known word in it, in the order of the list."""
    return [(f"{extractor}|{tag}", word) for word, *tags in R.TAGGED_WORDS if word in text for extractor, tag in zip(("ginza", "hf", "sudachi"), tags)]


def _tagged(spark, sf) -> DataFrame:
    found = extract_entities(R.scenes(spark, sf), "doc_id", "text", extractor=tagged_words)
    name = F.split("tag", r"\|", 2)
    return found.select("doc_id", name[0].alias("extractor"), name[1].alias("tag"), "term")


def entity_slots(spark, sf):
    """M10 + F17: slots of the words of three extractors by their rule tables."""
    return map_tags(_tagged(spark, sf), all_digits("term")).select("doc_id", "extractor", "slot", "term")


def scene_pools(spark, sf):
    """A17 + O6 + U3: one sorted pool per category over two term sets, keyword rules and mapped tags."""
    tags = entity_slots(spark, sf).select(F.col("slot").alias("category"), "term")
    return vocab_pools(vocab_long(scene_terms(spark, sf), tags), max_terms=10_000).select("category", F.array_join("terms", ",").alias("terms"), "size")


def _slot_prompts(spark, sf) -> DataFrame:
    x = R.scenes(spark, sf).select("doc_id", "text", "label", F.explode(F.array(*[F.lit(s) for s in SLOTS])).alias("target"))
    prompt = None
    for s in SLOTS:
        p = slot_prompt(s, F.col("text"), F.col("label"), R.TEMPLATE_SLOT)
        prompt = F.when(F.col("target") == s, p) if prompt is None else prompt.when(F.col("target") == s, p)
    return x.select("doc_id", "target", prompt.alias("prompt"))


def _added(scored: DataFrame) -> DataFrame:
    p = P.parse_yes_no(F.col("response"))
    keep = (p["decision"] == "YES") & (p["text"] != P.NOT_AVAILABLE)
    return scored.select("doc_id", "target", p["decision"].alias("decision"), F.when(keep, p["text"]).alias("added_info"))


def scene_slots(spark, sf):
    """M9 + F21 as expressions: the rule stand-in answers in the scan, both reply branches occur."""
    return _added(_slot_prompts(spark, sf).select("doc_id", "target", stand_in_column("prompt").alias("response")))


def scene_slot_counts(spark, sf):
    """Added and total per slot, through the batch scorer."""
    scored = batch_score(_slot_prompts(spark, sf), "prompt", ["doc_id", "target"], stand_in_scorer, _RESPONSE_FIELD, pause_s=0.0)
    return _added(scored).groupBy("target").agg(F.count("added_info").alias("n_added"), F.count(F.lit(1)).alias("total"))


def scene_feedback(spark, sf):
    """M8: feedback prompts of rejected rewrites; the reply depends on the scene and on the slot asked for."""
    x = R.scenes(spark, sf).where(F.col("doc_id") % 3 == 0)
    word = F.element_at(F.array(*[F.lit(w) for w, _ in SLOTS.values()]), (F.col("doc_id") % len(SLOTS) + 1).cast("int"))
    prompt = F.concat(F.lit("「"), word, F.lit("」の情報を補い、YES または NO で答えてください。\n"), "text")
    reply = stand_in_column(prompt)
    return x.select("doc_id", reply.alias("response"), P.parse_yes_no(reply)["decision"].alias("decision"))


QUERIES = {
    "scene_terms": scene_terms,
    "entity_slots": entity_slots,
    "scene_pools": scene_pools,
    "scene_slots": scene_slots,
    "scene_slot_counts": scene_slot_counts,
    "scene_feedback": scene_feedback,
}
