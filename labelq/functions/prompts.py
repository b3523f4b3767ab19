"""Prompt rendering F9-F14 as Column expressions.

Templates are plan-time constants (a small dimension of a few rows), so rendering is a
``concat`` of literal pieces and row columns: no Python per row.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelq.functions.normalize import label_text
from labelq.functions.text import col_of

# Instruction / response headings wrapped around a rendered template.
INSTRUCTION_HEAD = "### 指示:\n"
RESPONSE_HEAD = "\n\n### 応答:\n"
# Few-shot block layout.
FEWSHOT_HEAD = "\n### 判定の参考例:\n"
FEWSHOT_ITEM = "文章: 「{sent}」\nラベル: {label}\n判定: {answer}\n---\n"
FEWSHOT_TRUE = "[TRUE]"
FEWSHOT_FALSE = "[FALSE]"

# Per-slot words and examples of the slot prompt.
SLOTS = {
    "when": ("いつ", "朝食時、昼食時、帰宅時など"),
    "where": ("どこで", "学校の廊下、自宅のトイレ、デパートなど"),
    "who": ("だれが", "母親、知人、見知らぬ男性など"),
}


def render_replace(template: Column | str, text: Column | str, label: Column | str) -> Column:
    """sequential ``replace`` of ``{text}`` then ``{label}`` (a ``{label}`` inside the
    sentence is replaced too, as in the reference), wrapped in the two headings."""
    tpl = F.lit(template) if isinstance(template, str) else template
    instruction = F.replace(F.replace(tpl, F.lit("{text}"), col_of(text)), F.lit("{label}"), label_text(label))
    return F.concat(F.lit(INSTRUCTION_HEAD), instruction, F.lit(RESPONSE_HEAD))


def template_slots(template: str) -> list[str]:
    return [name for _, name, _, _ in Formatter().parse(template) if name is not None]


def render_format(template: str, **slots: Column | str) -> Column:
    """``template.format(**slots)`` with str.format semantics (values are not
    re-scanned, ``{{`` / ``}}`` are escapes). An unknown slot raises once, at plan time."""
    pieces: list[Column] = []
    for literal, name, spec, conv in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is None:
            continue
        if name not in slots:
            raise KeyError(f"template slot {{{name}}} has no value")
        if spec or conv:
            raise ValueError(f"format spec on slot {{{name}}} is not supported")
        pieces.append(F.coalesce(col_of(slots[name]).cast("string"), F.lit("None")))
    return F.concat(*pieces) if pieces else F.lit("")


def fewshot_item(sent: Column | str, label: Column | str, is_true: Column | str) -> Column:
    """one example of the few-shot block."""
    answer = F.when(col_of(is_true), F.lit(FEWSHOT_TRUE)).otherwise(F.lit(FEWSHOT_FALSE))
    return render_format(FEWSHOT_ITEM, sent=sent, label=label_text(label), answer=answer)


def slot_prompt(slot: str, text: Column | str, label: Column | str, template: str) -> Column:
    """the slot prompt for one of when / where / who; another slot raises."""
    if slot not in SLOTS:
        raise ValueError(f"invalid slot {slot!r}")
    word, example = SLOTS[slot]
    return render_format(template, word=F.lit(word), example=F.lit(example), text=text, label=label)


def chat_messages(system: Column | str, user: Column | str) -> Column:
    """the (system, user) message list."""
    sys_c = F.lit(system) if isinstance(system, str) else system
    return F.array(
        F.struct(F.lit("system").alias("role"), sys_c.alias("content")),
        F.struct(F.lit("user").alias("role"), col_of(user).alias("content")),
    )
