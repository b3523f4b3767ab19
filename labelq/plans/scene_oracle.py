"""DuckDB SQL of the scene queries, restated from the role and rule definitions."""

from __future__ import annotations

from labelq.functions.prompts import SLOTS
from labelq.functions.rules import KEYWORD_RULES
from labelq.plans import oracle as O
from labelq.plans import roles as R

S = O.S
_TEXT = "(CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN {S(x)}" for i, x in enumerate(R.SCENES)) + " END || chr(10) || text)"
SCENE_ITEMS = f"(SELECT doc_id, {_TEXT} AS text, label FROM {O.ITEMS})"


def _terms() -> str:
    parts = [f"SELECT doc_id, '{cat}' AS category, unnest(regexp_extract_all(text, {S(pat)}, 2)) AS term FROM {SCENE_ITEMS}" for cat, pat in KEYWORD_RULES]
    return f"(SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE NOT (category = 'who' AND term = '誰'))"


def _slots() -> str:
    words = ", ".join(f"({S(w)}, {S(a)}, {S(b)}, {S(c)})" for w, a, b, c in R.TAGGED_WORDS)
    slots = """SELECT term, 'ginza' AS extractor, CASE WHEN ginza IN ('DATE', 'TIME', 'EVENT') THEN 'when' WHEN ginza IN ('LOC', 'FACILITY', 'GPE') THEN 'where'
                 WHEN ginza IN ('PERSON', 'NORP', 'ORG', 'PRODUCT') THEN 'who' END AS slot FROM w
        UNION ALL SELECT term, 'hf', CASE WHEN hf IN ('DATE', 'TIME', 'TIM') THEN 'when' WHEN hf IN ('LOC', 'GPE', 'FAC') THEN 'where'
                 WHEN hf IN ('PER', 'PSN', 'ORG') THEN 'who' END FROM w
        UNION ALL SELECT term, 'sudachi', 'when' FROM w WHERE (pos LIKE '名詞,時相名詞%' OR pos = '名詞,普通名詞,副詞可能') AND length(term) > 1
        UNION ALL SELECT term, 'sudachi', 'where' FROM w WHERE pos = '名詞,固有名詞,地名' OR (pos LIKE '名詞,%' AND term IN ('学校', '家', '公園', '病院', '店', '部屋'))
        UNION ALL SELECT term, 'sudachi', 'who' FROM w WHERE pos = '名詞,固有名詞,人名' OR pos LIKE '代名詞%' OR term IN ('友達', '先生', '母', '父', '子供', '上司', '部下')"""
    return f"""(WITH w(term, ginza, hf, pos) AS (VALUES {words}), s AS ({slots})
      SELECT doc_id, extractor, slot, term FROM {SCENE_ITEMS} JOIN s ON contains(text, term) WHERE slot IS NOT NULL)"""


def _slot_replies() -> str:
    whens = []
    for s, (word, example) in SLOTS.items():
        whens.append(f"WHEN '{s}' THEN {O.fmt(R.TEMPLATE_SLOT, word=S(word), example=S(example), text='i.text', label='i.label')}")
    targets = ", ".join(f"('{s}')" for s in SLOTS)
    rows = f"(SELECT i.doc_id, t.target, CASE t.target {' '.join(whens)} END AS prompt FROM {SCENE_ITEMS} i, (VALUES {targets}) t(target))"
    decision, text = O.yes_no("response")
    return f"""(SELECT doc_id, target, {decision} AS decision, CASE WHEN {decision} = 'YES' AND {text} <> {S(O.NOT_AVAILABLE)} THEN {text} END AS added_info
      FROM (SELECT doc_id, target, {O.stand_in('prompt')} AS response FROM {rows}))"""


def _feedback() -> str:
    words = ", ".join(S(w) for w, _ in SLOTS.values())
    prompt = f"('「' || list_extract([{words}], doc_id % {len(SLOTS)} + 1) || '」の情報を補い、YES または NO で答えてください。' || chr(10) || text)"
    return f"""(SELECT doc_id, response, {O.yes_no('response')[0]} AS decision
      FROM (SELECT doc_id, {O.stand_in('prompt')} AS response FROM (SELECT doc_id, {prompt} AS prompt FROM {SCENE_ITEMS} WHERE doc_id % 3 = 0)))"""


ORACLE_SQL = {
    "scene_terms": f"SELECT doc_id, category, term FROM {_terms()}",
    "entity_slots": f"SELECT * FROM {_slots()}",
    "scene_pools": f"""SELECT category, string_agg(term, ',' ORDER BY term) AS terms, CAST(count(*) AS BIGINT) AS size
      FROM (SELECT category, term FROM {_terms()} UNION SELECT slot, term FROM {_slots()}) GROUP BY category""",
    "scene_slots": f"SELECT * FROM {_slot_replies()}",
    "scene_slot_counts": f"SELECT target, CAST(count(added_info) AS BIGINT) AS n_added, CAST(count(*) AS BIGINT) AS total FROM {_slot_replies()} GROUP BY target",
    "scene_feedback": f"SELECT * FROM {_feedback()}",
}
