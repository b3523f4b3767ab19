"""DuckDB SQL oracles for the registered queries.

Each query is restated in plain SQL over the driver's views (documents, labels, events,
conversations, benchmark). The statements are written from the role definitions, not from
the Spark plans: votes come straight from the label columns, dense ids from a global
``row_number``, precedence from ``CASE`` over left joins. Shared fixed values (reply forms,
templates, patterns) are imported so both sides use the same text.
"""

from __future__ import annotations

from labelq.functions.normalize import LABEL_TEXT
from labelq.functions.parsers import (
    NOT_AVAILABLE,
    OUTPUT_HEADING,
    PHRASE_ACCEPTABLE,
    PHRASE_NOT_ACCEPTABLE,
    STEPWISE_MARKER,
    YES_NO_PATTERN_RE2,
)
from labelq.functions.prompts import (
    FEWSHOT_FALSE,
    FEWSHOT_HEAD,
    FEWSHOT_TRUE,
    INSTRUCTION_HEAD,
    RESPONSE_HEAD,
    SLOTS,
)
from labelq.functions.rules import KEYWORD_RULES, STAND_IN_DEFAULT, STAND_IN_RULES
from labelq.functions.text import sql_ascii_digits, sql_py_strip, sql_str
from labelq.operators.vocab import ISDIGIT_CLASS, MAX_TERM_CHARS
from labelq.plans import roles as R
from labelq.plans.constants import GATE_PHASES, GATED_RESPONSE

S = sql_str
STRIP = sql_py_strip


def label_text(x: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN {S(LABEL_TEXT[0])} ELSE {S(LABEL_TEXT[1])} END)"


def label_text_strict(x: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN {S(LABEL_TEXT[0])} WHEN {x} = 1 THEN {S(LABEL_TEXT[1])} END)"


def fmt(template: str, **vals: str) -> str:
    """str.format of a template with SQL expressions (NULL renders as 'None')."""
    from string import Formatter

    parts = []
    for lit, name, _, _ in Formatter().parse(template):
        if lit:
            parts.append(S(lit))
        if name is not None:
            parts.append(f"coalesce(CAST({vals[name]} AS VARCHAR), 'None')")
    return "(" + " || ".join(parts) + ")"


def echo(text: str, label: str) -> str:
    tpl = S(R.TEMPLATE_CLASSIFY)
    inner = f"replace(replace({tpl}, '{{text}}', {text}), '{{label}}', {label_text(label)})"
    return f"({S(INSTRUCTION_HEAD)} || {inner} || {S(RESPONSE_HEAD)})"


def reply(key: str, text: str, offset: int = 0) -> str:
    whens = " ".join(
        f"WHEN {i} THEN {S(pre)} || {text} || {S(suf)}" for i, (pre, suf) in enumerate(R.REPLY_FORMS)
    )
    return f"(CASE ({key} + {offset}) % 8 {whens} END)"


def verdict(r: str) -> str:
    return f"coalesce(contains(upper({r}), 'TRUE'), false)"


def bracket(r: str) -> str:
    return f"coalesce(contains(upper({r}), '[TRUE]'), false)"


def stepwise(r: str) -> str:
    m = S(STEPWISE_MARKER)
    tail = f"upper(list_last(string_split({r}, {m})))"
    has = f"coalesce(contains({r}, {m}), false)"
    return (
        f"(CASE WHEN {has} AND contains({tail}, 'TRUE') THEN true "
        f"WHEN {has} AND contains({tail}, 'FALSE') THEN false ELSE {verdict(r)} END)"
    )


def label_parse(r: str) -> str:
    s = STRIP(r)
    return (
        f"(CASE WHEN contains({s}, {S(PHRASE_NOT_ACCEPTABLE)}) THEN 1 "
        f"WHEN contains({s}, {S(PHRASE_ACCEPTABLE)}) THEN 0 ELSE -1 END)"
    )


def score(r: str) -> str:
    d = sql_ascii_digits(f"regexp_extract({r}, '(\\p{{Nd}}+)', 1)")
    s = f"ltrim({d}, '0')"
    v = f"(CASE WHEN {s} = '' THEN 0 ELSE TRY_CAST({s} AS INTEGER) END)"
    return (
        f"(CASE WHEN coalesce({d}, '') = '' THEN CAST(NULL AS INTEGER) WHEN length({s}) > 2 THEN 10 "
        f"ELSE least(greatest({v}, 0), 10) END)"
    )


def heading_strip(x: str) -> str:
    return STRIP(f"replace({STRIP(x)}, {S(OUTPUT_HEADING)}, '')")


def stand_in(p: str) -> str:
    whens = []
    for needles, rep in STAND_IN_RULES:
        cond = " AND ".join(f"contains({p}, {S(n)})" for n in needles)
        whens.append(f"WHEN {cond} THEN {S(rep)}")
    return f"(CASE {' '.join(whens)} ELSE {S(STAND_IN_DEFAULT)} END)"


def yes_no(r: str) -> tuple[str, str]:
    s = STRIP(r)
    w = f"upper(regexp_extract({s}, {S(YES_NO_PATTERN_RE2)}, 1))"
    t = STRIP(f"regexp_extract({s}, {S(YES_NO_PATTERN_RE2)}, 2)")
    matched = f"coalesce({w} <> '', false)"
    return (
        f"(CASE WHEN {matched} THEN {w} ELSE 'NO' END)",
        f"(CASE WHEN {matched} AND {w} = 'YES' THEN {t} ELSE {S(NOT_AVAILABLE)} END)",
    )


def md5key(k: str, seed: int = 42) -> str:
    return f"md5(CAST({k} AS VARCHAR) || '-{seed}')"


def raw_flag(toxic: str, key: str) -> str:
    return (
        f"(CASE WHEN {toxic} = 1 THEN (CASE {key} % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' true ' WHEN 2 THEN 'True' ELSE '1' END) "
        f"WHEN {toxic} = 0 THEN (CASE {key} % 4 WHEN 0 THEN 'FALSE' WHEN 1 THEN '' WHEN 2 THEN 'false ' ELSE 'no' END) END)"
    )


def lenient(x: str) -> str:
    return f"coalesce(upper({STRIP(f'CAST({x} AS VARCHAR)')}) = 'TRUE', false)"


def strict(x: str) -> str:
    return f"(CASE {x} WHEN 'True' THEN true WHEN 'False' THEN false WHEN 'TRUE' THEN true WHEN 'FALSE' THEN false END)"


def quadrant(label: str, flag: str) -> str:
    return (
        f"(CASE WHEN {label} = 1 AND NOT {flag} THEN 'A' WHEN {label} = 0 AND {flag} THEN 'B' "
        f"WHEN {label} = 1 AND {flag} THEN 'C' WHEN {label} = 0 AND NOT {flag} THEN 'D' END)"
    )


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN NULL ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"


def ratio0(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"


LABELLED = (
    "(SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, 1 - l.quality AS label, l.toxic = 1 AS flagged, "
    "l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
)
ITEMS = (
    "(SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, 1 - l.quality AS label, l.toxic "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
)
_ECHO = echo("text", "label")
_RAW = f"{_ECHO} || {reply('doc_id', 'text')}"
RESPONSES = f"(SELECT doc_id, source, label, {STRIP(f'replace({_RAW}, {_ECHO}, {S(str())})')} AS response FROM {ITEMS})"
VOTES = (
    "(SELECT doc_id, fa AS flag_a, fb AS flag_b, fc AS flag_c, "
    "CAST(fa AS INTEGER) + CAST(fb AS INTEGER) + CAST(fc AS INTEGER) AS votes "
    f"FROM (SELECT doc_id, toxic = 1 AS fa, quality = 0 AS fb, n_chars < 400 AS fc FROM {LABELLED}))"
)
VOTES_FULL = (
    "(SELECT doc_id, flag_a, flag_b, flag_c, votes, CAST(votes AS DOUBLE) / 3.0 AS vote_ratio, 3 AS n_raters, "
    f"votes >= 2 AS gt_majority, votes >= 1 AS gt_union FROM {VOTES})"
)
SCORE_EVENTS = (
    f"(SELECT event_id, event_type AS run, user_id % 2 = 0 AS gt_is_ambiguous, "
    f"{score(S(R.SCORE_PREFIX) + ' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR)')} AS predicted_score FROM events)"
)


def confusion_cols(t: str, p: str) -> str:
    return (
        f"CAST(count_if({t} AND {p}) AS BIGINT) AS tp, CAST(count_if({t} AND NOT {p}) AS BIGINT) AS fn, "
        f"CAST(count_if(NOT {t} AND {p}) AS BIGINT) AS fp, CAST(count_if(NOT {t} AND NOT {p}) AS BIGINT) AS tn, "
        f"CAST(count(*) AS BIGINT) AS n"
    )


METRIC_COLS = (
    f"{ratio('tp + tn', 'n')} AS accuracy, {ratio0('tp', 'tp + fp')} AS precision, "
    f"{ratio0('tp', 'tp + fn')} AS recall, {ratio0('2 * tp', '2 * tp + fp + fn')} AS f1"
)


def _kappa(n11: str, n10: str, n01: str, n00: str) -> str:
    n = f"CAST({n11} + {n10} + {n01} + {n00} AS DOUBLE)"
    po = f"(CAST({n11} + {n00} AS DOUBLE) / {n})"
    pe = f"(CAST(({n11} + {n10}) * ({n11} + {n01}) + ({n01} + {n00}) * ({n10} + {n00}) AS DOUBLE) / ({n} * {n}))"
    return f"(CASE WHEN 1.0::DOUBLE - {pe} = 0 THEN NULL ELSE ({po} - {pe}) / (1.0::DOUBLE - {pe}) END)"


PAIRS = [("a", "b"), ("b", "c"), ("c", "a")]


def _pair_sums() -> str:
    cols = []
    for a, b in PAIRS:
        fa, fb = f"flag_{a}", f"flag_{b}"
        cols += [
            f"CAST(count_if({fa} AND {fb}) AS BIGINT) AS n11_{a}_{b}",
            f"CAST(count_if({fa} AND NOT {fb}) AS BIGINT) AS n10_{a}_{b}",
            f"CAST(count_if(NOT {fa} AND {fb}) AS BIGINT) AS n01_{a}_{b}",
            f"CAST(count_if(NOT {fa} AND NOT {fb}) AS BIGINT) AS n00_{a}_{b}",
        ]
    return ", ".join(cols)


SUMS = (
    "(SELECT CAST(count(*) AS BIGINT) AS n, CAST(count_if(votes = 0 OR votes = 3) AS BIGINT) AS n_complete, "
    "CAST(sum(greatest(votes, 3 - votes)) AS BIGINT) AS sum_agree, CAST(sum(votes) AS BIGINT) AS sum_v, "
    "CAST(sum(votes * votes + (3 - votes) * (3 - votes)) AS BIGINT) AS sum_sq, "
    "CAST(count_if(votes >= 2) AS BIGINT) AS majority_true, CAST(count_if(votes >= 1) AS BIGINT) AS union_true, "
    "CAST(count_if(flag_a) AS BIGINT) AS true_a, CAST(count_if(flag_b) AS BIGINT) AS true_b, "
    f"CAST(count_if(flag_c) AS BIGINT) AS true_c, {_pair_sums()} FROM {VOTES})"
)


def _fleiss() -> str:
    nk = "(CAST(n AS DOUBLE) * 3.0::DOUBLE)"
    pbar = f"(CAST(sum_sq - n * 3 AS DOUBLE) / ({nk} * 2.0::DOUBLE))"
    p1 = f"(CAST(sum_v AS DOUBLE) / {nk})"
    pe = f"({p1} * {p1} + (1.0::DOUBLE - {p1}) * (1.0::DOUBLE - {p1}))"
    return f"(CASE WHEN 1.0::DOUBLE - {pe} = 0 THEN NULL ELSE ({pbar} - {pe}) / (1.0::DOUBLE - {pe}) END)"


def _kappa_of(a: str, b: str) -> str:
    return _kappa(f"n11_{a}_{b}", f"n10_{a}_{b}", f"n01_{a}_{b}", f"n00_{a}_{b}")


def _predictions() -> str:
    r = "response"
    return f"""(SELECT * FROM (
      SELECT doc_id, source AS model, '{R.MODEL_PROMPT}' AS prompt, 'classification' AS method, {verdict(r)} AS pred FROM {RESPONSES}
      UNION ALL SELECT doc_id, source, '{R.MODEL_PROMPT}', 'stepwise', {stepwise(r)} FROM {RESPONSES}
      UNION ALL SELECT doc_id, source, '{R.MODEL_PROMPT}', 'scoring', {score(r)} >= 5 FROM {RESPONSES}
    ) WHERE pred IS NOT NULL)"""


REEVAL = f"""(SELECT model, method, prompt, pred, gt_type, truth FROM (
  SELECT p.model, p.method, p.prompt, p.pred, 'gt_majority' AS gt_type, v.gt_majority AS truth
  FROM {_predictions()} p LEFT JOIN {VOTES_FULL} v ON p.doc_id = v.doc_id
  UNION ALL
  SELECT p.model, p.method, p.prompt, p.pred, 'gt_union', v.gt_union
  FROM {_predictions()} p LEFT JOIN {VOTES_FULL} v ON p.doc_id = v.doc_id))"""

CONF_UNMATCHED = (
    "CAST(count_if(truth IS NOT NULL AND truth AND pred) AS BIGINT) AS tp, "
    "CAST(count_if(truth IS NOT NULL AND truth AND NOT pred) AS BIGINT) AS fn, "
    "CAST(count_if(truth IS NOT NULL AND NOT truth AND pred) AS BIGINT) AS fp, "
    "CAST(count_if(truth IS NOT NULL AND NOT truth AND NOT pred) AS BIGINT) AS tn, "
    "CAST(count_if(truth IS NOT NULL) AS BIGINT) AS n, CAST(count_if(truth IS NULL) AS BIGINT) AS n_unmatched"
)


def _annotation() -> str:
    gen = f"{S(R.HEADING_PREFIX)} || text"
    return (
        f"(SELECT doc_id, text AS target_sent, label, {label_text('label')} AS target_label_str, "
        f"{heading_strip(gen)} AS augmented_sent, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS is_ok, "
        f"'context: ' || lang AS feedback_comment FROM {LABELLED})"
    )


def _regen() -> str:
    prompt = fmt(
        R.TEMPLATE_FEEDBACK, original="target_sent", previous="augmented_sent", label="target_label_str", comment="feedback_comment"
    )
    return (
        f"(SELECT doc_id, prompt, {stand_in('prompt')} AS response FROM "
        f"(SELECT doc_id, {prompt} AS prompt FROM {_annotation()} WHERE is_ok = 0))"
    )


def _resolved() -> str:
    return f"""(SELECT a.doc_id, a.target_sent, a.target_label_str,
      CASE WHEN m.doc_id IS NOT NULL THEN m.final_manual_sent
           WHEN g.doc_id IS NOT NULL AND g.is_ok_step2 = 1 THEN g.augmented_sent_step2
           ELSE a.augmented_sent END AS final_sent,
      CASE WHEN m.doc_id IS NOT NULL THEN 'step3'
           WHEN g.doc_id IS NOT NULL AND g.is_ok_step2 = 1 THEN 'step2' ELSE 'step1' END AS source
    FROM {_annotation()} a
    LEFT JOIN (SELECT doc_id, target_sent || ' (manual)' AS final_manual_sent FROM {_annotation()} WHERE doc_id % 15 = 0) m
      ON a.doc_id = m.doc_id
    LEFT JOIN (SELECT doc_id, {heading_strip('response')} AS augmented_sent_step2,
                      CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS is_ok_step2 FROM {_regen()}) g
      ON a.doc_id = g.doc_id)"""


def _step_counts(src: str) -> str:
    return (
        "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count_if(source = 'step1') AS BIGINT) AS step1, "
        f"CAST(count_if(source = 'step2') AS BIGINT) AS step2, CAST(count_if(source = 'step3') AS BIGINT) AS step3 FROM {src}"
    )


def _slot_rows() -> str:
    whens = []
    for s, (word, example) in SLOTS.items():
        p = fmt(R.TEMPLATE_SLOT, word=S(word), example=S(example), text="i.text", label="i.label")
        whens.append(f"WHEN '{s}' THEN {p}")
    targets = ", ".join(f"('{s}')" for s in SLOTS)
    return (
        f"(SELECT i.doc_id, t.target, CASE t.target {' '.join(whens)} END AS prompt "
        f"FROM {ITEMS} i, (VALUES {targets}) t(target))"
    )


def _slot_augmented() -> str:
    dec, txt = yes_no("response")
    return (
        f"(SELECT doc_id, target, CASE WHEN {dec} = 'YES' AND {txt} <> {S(NOT_AVAILABLE)} THEN {txt} END AS added_info "
        f"FROM (SELECT doc_id, target, {stand_in('prompt')} AS response FROM {_slot_rows()}))"
    )


def _terms(keep: str = "") -> str:
    parts = []
    for cat, pat in KEYWORD_RULES:
        parts.append(
            f"SELECT {keep}'{cat}' AS category, unnest(regexp_extract_all(text, {S(pat)}, 2)) AS term FROM documents"
        )
    u = " UNION ALL ".join(parts)
    t = STRIP("term")
    return (
        f"(SELECT * FROM (SELECT {keep}category, {t} AS term FROM ({u})) "
        f"WHERE length(term) > 0 AND length(term) < {MAX_TERM_CHARS} AND NOT regexp_full_match(term, {S(ISDIGIT_CLASS + '+')}) "
        f"AND NOT (category = 'who' AND term = '誰'))"
    )


def _fewshot() -> str:
    item = (
        f"'文章: 「' || text || '」\nラベル: ' || {label_text('label')} || '\n判定: ' || "
        f"CASE WHEN gt_majority THEN {S(FEWSHOT_TRUE)} ELSE {S(FEWSHOT_FALSE)} END || '\n---\n'"
    )
    return f"""(SELECT {S(FEWSHOT_HEAD)} || coalesce(string_agg(item, '' ORDER BY ord), '') AS block FROM (
      SELECT {md5key('doc_id', 43)} AS ord, {item} AS item FROM (
        SELECT *, row_number() OVER (PARTITION BY gt_majority ORDER BY {md5key('doc_id')}, doc_id) AS rn
        FROM (SELECT l.doc_id, l.text, l.label, v.gt_majority FROM {LABELLED} l JOIN {VOTES_FULL} v ON l.doc_id = v.doc_id))
      WHERE rn <= 3))"""


def _stratified() -> str:
    return f"""(SELECT doc_id, gt_majority FROM (
      SELECT doc_id, gt_majority, row_number() OVER (PARTITION BY gt_majority ORDER BY {md5key('doc_id')}, doc_id) AS rn
      FROM {VOTES_FULL}) WHERE rn <= CASE WHEN gt_majority THEN 5 ELSE 95 END)"""


def _pairs() -> str:
    it = "(SELECT d.doc_id, d.text AS sent, 1 - l.quality AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
    return f"""(SELECT t.doc_id, t.sent AS target_sent, t.label AS target_label, p.doc_id AS pair_id, p.sent AS pair_sent,
      p.label AS pair_label, {label_text_strict('t.label')} AS target_label_str, {label_text_strict('p.label')} AS pair_label_str
      FROM {it} t JOIN {it} p ON p.doc_id = CASE WHEN t.doc_id % 2 <> 0 THEN t.doc_id + 1 ELSE t.doc_id - 1 END)"""


def _categorical() -> str:
    cols = [f"{bracket(reply('doc_id', 'text', i + 1))} AS pred_{c}" for i, c in enumerate(R.CATEGORIES)]
    anyc = " OR ".join(f"pred_{c}" for c in R.CATEGORIES)
    return f"(SELECT *, {anyc} AS pred_is_ambiguous FROM (SELECT doc_id, {', '.join(cols)} FROM documents))"


def _moderation_score() -> str:
    n = "CAST(length(text) AS DOUBLE)"
    lines = "CAST(length(text) - length(replace(text, chr(10), '')) AS DOUBLE)"
    return (
        f"(SELECT doc_id, label, {n} / ({n} + 1000.0::DOUBLE) >= 0.5 AS moderation_flagged, "
        f"{n} / ({n} + 1000.0::DOUBLE) AS score_length, {lines} / ({lines} + 10.0::DOUBLE) AS score_lines, 'ok' AS status "
        f"FROM {ITEMS})"
    )


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    quad_rows = (
        f"SELECT doc_id, label, flagged AS moderation_flagged, {quadrant('label', 'flagged')} AS quadrant, "
        f"{quadrant('label', 'flagged')} = 'A' AS is_ambiguous_candidate, {quadrant('label', 'flagged')} = 'B' AS is_contextual_safety "
        f"FROM {LABELLED}"
    )
    q["quadrant_rows"] = quad_rows
    q["quadrant_counts"] = f"SELECT quadrant, CAST(count(*) AS BIGINT) AS n FROM ({quad_rows}) GROUP BY quadrant"
    enrich = (
        "SELECT d.doc_id, coalesce(m.original_label, 0) AS original_label, "
        "coalesce(m.moderation_flagged, false) AS moderation_flagged, m.ID IS NOT NULL AS matched FROM documents d "
        f"LEFT JOIN (SELECT doc_id AS ID, 1 - quality AS original_label, {lenient(raw_flag('toxic', 'doc_id'))} AS moderation_flagged "
        "FROM labels) m ON d.doc_id = m.ID"
    )
    q["moderation_enrich"] = enrich
    gate_rows = f"""(SELECT r.source, e.original_label = 1 AND e.moderation_flagged AS gated,
        v.gt_majority AS gt_is_ambiguous,
        CASE WHEN e.original_label = 1 AND e.moderation_flagged THEN false ELSE {verdict('r.response')} END AS pred_is_ambiguous
      FROM {RESPONSES} r JOIN ({enrich}) e ON r.doc_id = e.doc_id JOIN {VOTES_FULL} v ON r.doc_id = v.doc_id)"""
    q["gate_analysis"] = f"""SELECT source, filtered_total, filtered_ambiguous,
        {ratio0('filtered_total - filtered_ambiguous', 'filtered_total')} AS filter_success_rate,
        {ratio0('filtered_ambiguous', 'filtered_total')} AS filter_risk_rate, tp, fn, fp, tn, n, {METRIC_COLS}
      FROM (SELECT source, CAST(count_if(gated) AS BIGINT) AS filtered_total,
                   CAST(count_if(gated AND gt_is_ambiguous) AS BIGINT) AS filtered_ambiguous,
                   {confusion_cols('gt_is_ambiguous', 'pred_is_ambiguous')}
            FROM {gate_rows} GROUP BY source)"""
    rf = raw_flag("toxic", "doc_id")
    q["bool_normalise"] = (
        f"SELECT doc_id, {rf} AS raw_flag, {lenient(rf)} AS flag_lenient, {strict(rf)} AS flag_strict FROM {ITEMS}"
    )
    q["strict_flag_map"] = (
        f"SELECT quadrant, CAST(count(*) AS BIGINT) AS n FROM (SELECT {quadrant('label', strict(rf))} AS quadrant "
        f"FROM {LABELLED}) GROUP BY quadrant"
    )
    q["label_text"] = (
        f"SELECT doc_id, label, {label_text('label')} AS label_text, {label_text_strict('label')} AS label_text_strict FROM {ITEMS}"
    )
    model = "('org-' || lang || '/' || source || '-instruct')"
    path = "('prompts/' || lang || '/v0' || CAST(doc_id % 5 + 1 AS VARCHAR) || '_base.txt')"
    q["safe_name"] = (
        f"SELECT doc_id, {model} AS model_id, replace({model}, '/', '_') AS safe_model, "
        f"list_last(string_split({model}, '/')) AS model_base, "
        f"regexp_replace(list_last(string_split({path}, '/')), '\\.[^.]*$', '') AS prompt_name FROM documents"
    )
    r = "response"
    q["parse_label"] = (
        f"SELECT doc_id, {label_parse(r)} AS predicted_label, {label_parse(r)} = -1 AS parse_error FROM {RESPONSES}"
    )
    q["parse_verdict"] = f"SELECT doc_id, {verdict(r)} AS pred_is_ambiguous FROM {RESPONSES}"
    q["parse_bracket"] = f"SELECT doc_id, {bracket(r)} AS pred_bracket FROM {RESPONSES}"
    q["parse_stepwise"] = f"SELECT doc_id, {stepwise(r)} AS pred_stepwise FROM {RESPONSES}"
    q["parse_score"] = f"SELECT doc_id, {score(r)} AS predicted_score FROM {RESPONSES}"
    dec, txt = yes_no(r)
    q["parse_yes_no"] = f"SELECT doc_id, {dec} AS decision, {txt} AS added_info FROM {RESPONSES}"
    q["strip_echo"] = (
        f"SELECT doc_id, response, {heading_strip(S(R.HEADING_PREFIX) + ' || response')} AS rewrite FROM {RESPONSES}"
    )
    q["render_prompt"] = f"SELECT doc_id, {echo('text', 'label')} AS prompt FROM {ITEMS}"
    q["render_named"] = (
        "SELECT doc_id, "
        + fmt(
            R.TEMPLATE_PAIR,
            target_sent="target_sent", target_label_str="target_label_str",
            pair_sent="pair_sent", pair_label_str="pair_label_str",
        )
        + f" AS prompt FROM {_pairs()}"
    )
    q["slot_prompts"] = f"SELECT doc_id, target, prompt FROM {_slot_rows()}"
    q["fewshot_block"] = (
        f"SELECT item_id, (SELECT block FROM {_fewshot()}) || '\n' || {fmt(R.TEMPLATE_FEWSHOT, text='text')} AS prompt "
        "FROM benchmark"
    )
    q["chat_messages"] = (
        f"SELECT conv_id, turn, 0 AS msg_index, 'system' AS role, {S(R.SYSTEM_PROMPT)} AS content FROM conversations "
        f"WHERE role = 'user' UNION ALL SELECT conv_id, turn, 1, 'user', {echo('text', 'CAST(NULL AS INTEGER)')} "
        "FROM conversations WHERE role = 'user'"
    )
    q["rater_merge"] = f"SELECT doc_id, flag_a, flag_b, flag_c FROM {VOTES}"
    q["votes"] = f"SELECT doc_id, votes, vote_ratio, n_raters, gt_majority, gt_union FROM {VOTES_FULL}"
    kap = ", ".join(f"{_kappa_of(a, b)} AS kappa_{a}_{b}" for a, b in PAIRS)
    q["agreement_report"] = f"""SELECT n, {ratio('n_complete', 'n')} AS complete_agreement_rate,
        {ratio('sum_agree', 'n')} AS avg_agreement_number, {kap}, {_fleiss()} AS fleiss_kappa,
        majority_true, union_true, true_a, true_b, true_c,
        (0.0::DOUBLE + {_kappa_of('a', 'b')} + {_kappa_of('b', 'c')} + {_kappa_of('c', 'a')}) / 3.0::DOUBLE AS avg_pairwise_kappa
      FROM {SUMS}"""
    q["cohen_pairs"] = " UNION ALL ".join(
        f"SELECT '{a}' AS rater_1, '{b}' AS rater_2, n11_{a}_{b} AS n11, n10_{a}_{b} AS n10, n01_{a}_{b} AS n01, "
        f"n00_{a}_{b} AS n00, {_kappa_of(a, b)} AS kappa FROM {SUMS}"
        for a, b in PAIRS
    )
    q["fleiss"] = f"SELECT n, 3 AS k, sum_v, sum_sq, {_fleiss()} AS fleiss_kappa FROM {SUMS}"
    q["confusion_by_run"] = f"SELECT model, method, prompt, gt_type, {CONF_UNMATCHED} FROM {REEVAL} GROUP BY ALL"
    q["metrics_by_run"] = (
        f"SELECT *, {METRIC_COLS} FROM (SELECT model, method, prompt, {CONF_UNMATCHED} FROM {REEVAL} "
        "WHERE gt_type = 'gt_majority' GROUP BY ALL)"
    )
    q["reevaluate"] = (
        f"SELECT *, {METRIC_COLS} FROM (SELECT model, method, prompt, gt_type, {CONF_UNMATCHED} FROM {REEVAL} GROUP BY ALL)"
    )
    q["metrics_both_denominators"] = f"""SELECT *, {ratio('n_correct', 'n')} AS accuracy_all,
        {ratio('n_correct', 'n_valid')} AS accuracy_valid, {ratio0('tp', 'tp + fp')} AS precision,
        {ratio0('tp', 'tp + fn')} AS recall, {ratio0('2 * tp', '2 * tp + fp + fn')} AS f1,
        {ratio('n_parse_error', 'n')} AS parse_error_rate
      FROM (SELECT model, CAST(count(*) AS BIGINT) AS n, CAST(count_if(p <> -1) AS BIGINT) AS n_valid,
                   CAST(count_if(p = -1) AS BIGINT) AS n_parse_error,
                   CAST(count_if(p <> -1 AND y = (p = 1)) AS BIGINT) AS n_correct,
                   CAST(count_if(p <> -1 AND y AND p = 1) AS BIGINT) AS tp,
                   CAST(count_if(p <> -1 AND NOT y AND p = 1) AS BIGINT) AS fp,
                   CAST(count_if(p <> -1 AND y AND p <> 1) AS BIGINT) AS fn
            FROM (SELECT source AS model, label = 1 AS y, {label_parse('response')} AS p FROM {RESPONSES}
                  WHERE label IS NOT NULL) GROUP BY model)"""
    q["confusion_split"] = f"""SELECT doc_id, gt_is_ambiguous, pred_is_ambiguous,
        CASE WHEN gt_is_ambiguous AND pred_is_ambiguous THEN 'TP' WHEN gt_is_ambiguous THEN 'FN'
             WHEN pred_is_ambiguous THEN 'FP' ELSE 'TN' END AS cell
      FROM (SELECT v.doc_id, v.gt_majority AS gt_is_ambiguous, {verdict('r.response')} AS pred_is_ambiguous
            FROM {VOTES_FULL} v JOIN {RESPONSES} r ON v.doc_id = r.doc_id)"""
    q["score_crosstab"] = f"""WITH c AS (
        SELECT run, predicted_score, CAST(count_if(NOT gt_is_ambiguous) AS BIGINT) AS "False",
               CAST(count_if(gt_is_ambiguous) AS BIGINT) AS "True"
        FROM {SCORE_EVENTS} WHERE predicted_score IS NOT NULL GROUP BY ALL),
      g AS (SELECT run, CAST(x AS INTEGER) AS predicted_score FROM (SELECT DISTINCT run FROM c), range(0, 11) r(x))
      SELECT g.run, g.predicted_score, coalesce(c."False", 0) AS "False", coalesce(c."True", 0) AS "True",
             coalesce(c."False", 0) + coalesce(c."True", 0) AS "Total",
             {ratio('coalesce(c."True", 0)', 'coalesce(c."False", 0) + coalesce(c."True", 0)')} AS "True_Ratio"
      FROM g LEFT JOIN c ON g.run = c.run AND g.predicted_score = c.predicted_score"""
    q["score_threshold_metrics"] = f"""SELECT *, {METRIC_COLS} FROM (
        SELECT run, {confusion_cols('gt_is_ambiguous', 'predicted_score >= 5')}
        FROM {SCORE_EVENTS} WHERE predicted_score IS NOT NULL GROUP BY run)"""
    q["score_histogram"] = f"""SELECT run, bin, truth, n, 0.0::DOUBLE + CAST(bin AS DOUBLE) * 1.0::DOUBLE AS bin_lo,
        0.0::DOUBLE + CAST(bin + 1 AS DOUBLE) * 1.0::DOUBLE AS bin_hi FROM (
        SELECT run, CAST(least(floor((CAST(predicted_score AS DOUBLE) - 0.0::DOUBLE) / 1.0::DOUBLE), 10) AS INTEGER) AS bin,
               gt_is_ambiguous AS truth, CAST(count(*) AS BIGINT) AS n
        FROM {SCORE_EVENTS} WHERE predicted_score IS NOT NULL AND predicted_score >= 0 AND predicted_score <= 11
        GROUP BY ALL)"""
    q["categorical_any"] = f"SELECT * FROM {_categorical()}"
    q["categorical_counts"] = " UNION ALL ".join(
        f"SELECT '{c}' AS category, CAST(count_if(pred_{c}) AS BIGINT) AS n_true, CAST(count(*) AS BIGINT) AS n "
        f"FROM {_categorical()}"
        for c in R.CATEGORIES
    )
    q["sample_n"] = f"SELECT doc_id, lang FROM documents ORDER BY {md5key('doc_id')}, doc_id LIMIT 100"
    q["shuffle_ids"] = f"SELECT doc_id, row_number() OVER (ORDER BY {md5key('doc_id')}, doc_id) AS ID FROM documents"
    q["stratified_train"] = f"SELECT * FROM {_stratified()}"
    q["train_test_split"] = (
        f"SELECT doc_id, gt_majority FROM {VOTES_FULL} WHERE doc_id NOT IN (SELECT doc_id FROM {_stratified()})"
    )
    q["split_summary"] = f"""SELECT CAST(count(*) AS BIGINT) AS train_rows, CAST(count_if(gt_majority) AS BIGINT) AS train_true,
        (SELECT CAST(count(*) AS BIGINT) FROM {VOTES_FULL} WHERE doc_id NOT IN (SELECT doc_id FROM {_stratified()})) AS test_rows
      FROM {_stratified()}"""
    q["head_n"] = "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 10"
    q["union_renumber"] = (
        "SELECT doc_id, lang, source, row_number() OVER (ORDER BY lang, doc_id) AS Original_ID FROM documents"
    )
    q["pair_join"] = f"SELECT * FROM {_pairs()}"
    q["pair_missing"] = (
        "SELECT d.doc_id, CASE WHEN d.doc_id % 2 <> 0 THEN d.doc_id + 1 ELSE d.doc_id - 1 END AS pair_id FROM documents d "
        "WHERE NOT EXISTS (SELECT 1 FROM documents p WHERE p.doc_id = "
        "CASE WHEN d.doc_id % 2 <> 0 THEN d.doc_id + 1 ELSE d.doc_id - 1 END)"
    )
    q["resolve_final"] = f"SELECT * FROM {_resolved()}"
    q["resolve_counts"] = _step_counts(_resolved())
    q["resolve_subset"] = _step_counts(f"(SELECT * FROM {_resolved()} WHERE doc_id % 3 + 1 IN (1, 2))")
    q["regenerate_queue"] = (
        f"SELECT doc_id, prompt, response, {heading_strip('response')} AS augmented_sent_step2, 'ok' AS status FROM {_regen()}"
    )
    q["slot_augment"] = f"SELECT * FROM {_slot_augmented()}"
    q["slot_counts"] = (
        f"SELECT target, CAST(count(added_info) AS BIGINT) AS n_added, CAST(count(*) AS BIGINT) AS total "
        f"FROM {_slot_augmented()} GROUP BY target"
    )
    q["vocab_pools"] = f"SELECT DISTINCT category, term FROM {_terms()}"
    cats = ", ".join(f"('{c}')" for c, _ in KEYWORD_RULES)
    q["vocab_sizes"] = (
        f"SELECT c.category, coalesce(s.size, 0) AS size FROM (VALUES {cats}) c(category) LEFT JOIN "
        f"(SELECT category, CAST(count(*) AS BIGINT) AS size FROM (SELECT DISTINCT category, term FROM {_terms()}) "
        "GROUP BY category) s ON c.category = s.category"
    )
    q["extract_entities"] = f"SELECT doc_id, category, term FROM {_terms('doc_id, ')}"
    q["batch_score"] = f"""SELECT doc_id, label, moderation_flagged, score_length, score_lines, status,
        coalesce({quadrant('label', 'moderation_flagged')} = 'A', false) AS is_ambiguous_candidate,
        coalesce({quadrant('label', 'moderation_flagged')} = 'B', false) AS is_contextual_safety
      FROM {_moderation_score()}"""
    r = "response"
    q["result_tree"] = f"""SELECT doc_id, source AS model, 'classification' AS method, '{R.MODEL_PROMPT}' AS prompt,
        {verdict(r)} AS pred FROM {RESPONSES}
      UNION ALL SELECT doc_id, source, 'stepwise', '{R.MODEL_PROMPT}', {stepwise(r)} FROM {RESPONSES}"""
    q["result_layouts"] = f"""SELECT doc_id, source AS model, method, '{R.MODEL_PROMPT}' AS prompt,
        CASE WHEN method = 'scoring' THEN {score(r)} END AS predicted_score,
        CASE method WHEN 'classification' THEN (CASE WHEN doc_id % 97 <> 0 THEN {verdict(r)} END) WHEN 'scoring' THEN {score(r)} >= 5
                    WHEN 'stepwise' THEN {stepwise(r)} ELSE {bracket(r)} END AS pred,
        CASE method WHEN 'stepwise' THEN md5(nullif(response, '')) WHEN 'fewshot' THEN md5('"' || source || '",' || chr(10)) END AS response_md5,
        CASE WHEN method = 'classification' AND doc_id % 97 = 0 THEN 1 ELSE 0 END AS n_bad
      FROM {RESPONSES}, (VALUES ('classification'), ('scoring'), ('stepwise'), ('fewshot')) m(method)"""
    q["union_files"] = """SELECT doc_id, lang AS language, source, part, 0 AS n_bad,
        row_number() OVER (ORDER BY part, doc_id) AS Original_ID
      FROM documents JOIN (VALUES ('en', 0), ('de', 2), ('fr', 3), ('es', 4)) p(lang, part) USING (lang)"""
    q["read_encodings"] = """SELECT doc_id, encoding, md5(mark || regexp_replace(regexp_replace(text, '[^\\x01-\\x7F]', '', 'g'), '\\r', '', 'g')) AS sent_md5, 0 AS n_bad
      FROM documents JOIN (VALUES ('en', 'utf-8', 'é'), ('de', 'shift_jis', '文'), ('fr', 'cp932', '①'), ('es', 'euc-jp', '癰')) e(lang, encoding, mark) USING (lang)
      WHERE text IS NOT NULL AND doc_id IS NOT NULL"""
    q["ordered_sink"] = f"SELECT doc_id, votes, row_number() OVER (ORDER BY doc_id) AS position FROM {VOTES_FULL}"
    q["pair_targets"] = f"""SELECT t.doc_id, t.pair_id, i.doc_id IS NOT NULL AS pair_found, i.text AS pair_sent, i.label AS pair_label,
        {label_text_strict('i.label')} AS pair_label_str
      FROM (SELECT doc_id, CASE WHEN doc_id % 2 <> 0 THEN doc_id + 1 ELSE doc_id - 1 END AS pair_id FROM {VOTES_FULL} WHERE gt_majority) t
      LEFT JOIN {ITEMS} i ON i.doc_id = t.pair_id"""
    digit = f"regexp_matches(text, {S(ISDIGIT_CLASS)})"
    size = "(CAST(length(text) AS DOUBLE) / (CAST(length(text) AS DOUBLE) + 1000.0::DOUBLE) >= 0.5)"
    q["batch_score_failures"] = f"""SELECT doc_id, CASE WHEN {digit} THEN 'failed' ELSE 'ok' END AS status,
        CASE WHEN {digit} THEN 2 ELSE 1 END AS attempts, CASE WHEN NOT {digit} THEN {size} END AS moderation_flagged FROM documents"""
    gate = f"coalesce(label = 1 AND {lenient(raw_flag('toxic', 'doc_id'))}, false)"
    gated = f"""(SELECT doc_id, source, {gate} AS gated, NOT {gate} AND length(text) % 2 = 0 AS pred_is_ambiguous,
        CASE WHEN {gate} THEN {S(GATED_RESPONSE)}
             ELSE '考えた結果' || chr(10) || '最終判定: ' || CASE WHEN length(text) % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END END AS llm_raw_response,
        CASE WHEN {gate} THEN {S(GATE_PHASES[0])} ELSE {S(GATE_PHASES[1])} END AS phase,
        CASE WHEN {gate} THEN 'skipped' ELSE 'ok' END AS status FROM {ITEMS})"""
    q["gated_predictions"] = f"SELECT doc_id, source, pred_is_ambiguous, llm_raw_response, phase, status FROM {gated}"
    q["gated_scoring"] = " UNION ALL ".join(
        f"""SELECT '{form}' AS form, source, n_gated, tp, fn, fp, tn, n, {METRIC_COLS} FROM (
          SELECT g.source, CAST(count_if(g.gated) AS BIGINT) AS n_gated, {confusion_cols('v.gt_majority', 'g.pred_is_ambiguous')}
          FROM {gated} g JOIN {VOTES_FULL} v ON g.doc_id = v.doc_id WHERE {keep} GROUP BY g.source)"""
        for form, keep in (("keep", "true"), ("drop", "NOT g.gated")))
    return q


ORACLE_SQL = build()
