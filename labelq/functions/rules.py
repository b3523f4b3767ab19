"""The reference's rule-based stand-in for a model (F21) and the regex keyword rules of the
vocabulary fallback (F15), as fixed values, with Column and Python forms.

The stand-in keeps the pipeline testable without a model: it answers from substrings of
the prompt. Its branch order is part of the behaviour (first match wins).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelq.functions.text import col_of

# Fixed values: (all substrings that must occur in the prompt, reply), tested in order.
STAND_IN_RULES = [
    (("「いつ」の情報が加わることで", "信号が赤信号だったため車のアクセルを踏んだ"), "YES\n深夜"),
    (("「だれが」の情報が加わることで", "友人の皿に料理を取り分けようとした時"), "YES\n衛生観念のない知人が"),
    (("信号が赤信号だったため車のブレーキを踏んだ",), "NO\nN/A"),
    (("YES", "いつ"), "YES\n夜中の３時"),
    (("YES", "どこで"), "YES\n薄暗い路地裏で"),
    (("YES", "だれが"), "YES\n近所のおじさんが"),
]
STAND_IN_DEFAULT = "NO\nN/A"


def stand_in_reply(prompt: str) -> str:
    """Python form, used as the scorer of ``batch_score``."""
    for needles, reply in STAND_IN_RULES:
        if all(n in prompt for n in needles):
            return reply
    return STAND_IN_DEFAULT


def stand_in_scorer(prompts: list) -> list:
    return [{"response": stand_in_reply(p or "")} for p in prompts]


def stand_in_column(prompt: Column | str) -> Column:
    """Column form of the same rules (for plans that need no Python)."""
    p = col_of(prompt)
    expr = None
    for needles, reply in STAND_IN_RULES:
        cond = None
        for n in needles:
            c = p.contains(n)
            cond = c if cond is None else cond & c
        expr = F.when(cond, F.lit(reply)) if expr is None else expr.when(cond, F.lit(reply))
    return expr.otherwise(F.lit(STAND_IN_DEFAULT))


# Regex fallback of the vocabulary extractor (F15). Term = group 2.
KEYWORD_RULES = [
    (
        "when",
        r"(^|\s|[^、。])(夜中|深夜|朝|昼|夕方|午前|午後|年|月|日|分|週間|ヶ月|正月|クリスマス|今日|明日|先週|先月|昨日|明日|来年|祝日|連休)(に|で|の|には|まで|から|前|$)",
    ),
    (
        "where",
        r"(^|\s|[^、。])(学校|病院|道路|公園|自宅|家|ホテル|美術館|駅|職場|パチンコ|バー|店舗|店内|路上|会議室|教室内|山|海|空地|近所|風呂|浴槽|庭|デパート|テーブル)(で|に|へ|から|の|には|$)",
    ),
    (
        "who",
        r"(^|\s|[^、。])(友達|母親|父親|上司|部下|子供|生徒|老人|おばあさん|運転手|犯人|客|彼氏|妻|先生|同僚|誰|知人|娘|息子|家族|隣人|姉|兄|自分)(が|に|と|の|には|から|$)",
    ),
]
# Terms removed from a pool after extraction.
EXCLUDED_TERMS = {"who": ["誰"]}
