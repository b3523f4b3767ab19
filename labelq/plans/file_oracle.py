"""DuckDB SQL of the file queries, restated from the role definitions: what was written is what must be read back."""

from __future__ import annotations

from labelq.plans import oracle as O
from labelq.plans import roles as R
from labelq.plans.file_queries import TEMPLATES

S = O.S
NL = "chr(10)"


def _figure(label: str, value: str, digits: int | None = None) -> str:
    text = f"printf('%.{digits}f', {value})" if digits is not None else f"CAST({value} AS VARCHAR)"
    return f"{S(f' {label:<24}: ')} || coalesce({text}, 'nan')"


def _reports() -> str:
    rule, blank = S("-" * 30), f" || {NL} || {NL} || "
    join = f" || {NL} || "
    figures = join.join(_figure(n, n.lower(), 4) for n in ("Accuracy", "Precision", "Recall", "F1"))
    gate = blank.join([
        join.join(["'gate ' || source", rule]),
        join.join(["'Phase 1 Filtering Analysis:'", _figure("Filtered", "filtered_total"), _figure("Ambiguous among filtered", "filtered_ambiguous"),
                   _figure("Success rate", "filter_success_rate", 4), _figure("Risk rate", "filter_risk_rate", 4)]),
        join.join(["'Confusion Matrix:'", _figure("TP / FN", "(tp || ' / ' || fn)"), _figure("FP / TN", "(fp || ' / ' || tn)")]), figures])
    lines = f"""string_agg(lpad(CAST(predicted_score AS VARCHAR), 2, ' ') || ' ' || "True" || ' ' || "False" || ' ' || "Total", {NL} ORDER BY predicted_score)"""
    score = blank.join([join.join(["'score ' || run", rule]), join.join(["'Score True False Total:'", lines])])
    return f"""SELECT 'gate ' || source AS run, {gate} AS report FROM ({O.ORACLE_SQL['gate_analysis']})
      UNION ALL SELECT 'score ' || run, {score} FROM ({O.ORACLE_SQL['score_crosstab']}) GROUP BY run"""


def _raters() -> str:
    rows = O.VOTES_FULL
    return f"""SELECT doc_id, flag_a, flag_b AND doc_id % 5 <> 0 AS flag_b, flag_c AND doc_id % 50 <> 3 AS flag_c FROM {rows}"""


def _categories() -> str:
    truth = f"(SELECT c.*, v.gt_majority FROM {O._categorical()} c JOIN {O.VOTES_FULL} v ON c.doc_id = v.doc_id)"
    named = [*[(c, f"pred_{c}") for c in R.CATEGORIES], ("any", "pred_is_ambiguous")]
    return " UNION ALL ".join(
        f"""SELECT '{n}' AS detector, n_detected, tp, fn, fp, tn, n, {O.METRIC_COLS} FROM (
          SELECT CAST(count_if({c}) AS BIGINT) AS n_detected, {O.confusion_cols('gt_majority', c)} FROM {truth})""" for n, c in named)


def _prompts() -> str:
    whens = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(TEMPLATES))
    body = " ".join(f"WHEN {i} THEN {S(t)}" for i, t in enumerate(TEMPLATES.values()))
    prompt = f"replace(replace(CASE doc_id % {len(TEMPLATES)} {body} END, '{{text}}', text), '{{label}}', {O.label_text('label')})"
    return f"SELECT doc_id, CASE doc_id % {len(TEMPLATES)} {whens} END AS name, md5({prompt}) AS prompt_md5 FROM {O.ITEMS}"


_SPLITS = f"""SELECT 'quadrant' AS sink, quadrant AS part, doc_id FROM ({O.ORACLE_SQL['quadrant_rows']})
  UNION ALL SELECT 'slot', target, doc_id FROM {O._slot_augmented()} WHERE added_info IS NOT NULL
""" + " ".join(f"UNION ALL SELECT 'category', '{c}', doc_id FROM documents" for c in R.CATEGORIES)
_SIZE = "(CAST(length(text) AS DOUBLE) / (CAST(length(text) AS DOUBLE) + 1000.0::DOUBLE) >= 0.5)"

ORACLE_SQL = {
    "rater_sheet": "SELECT doc_id, lang, 3 AS n_blank FROM documents",
    "rater_files": _raters(),
    "metrics_json": O.ORACLE_SQL["metrics_by_run"],
    "run_reports": _reports(),
    "split_sinks": f"""SELECT sink, part, CAST(count(doc_id) AS BIGINT) AS n, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM ({_SPLITS})
      WHERE part IS NOT NULL GROUP BY sink, part""",
    "template_prompts": _prompts(),
    "optional_steps": O._step_counts(f"(SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'step2' ELSE 'step1' END AS source FROM {O._annotation()})"),
    "categorical_metrics": _categories(),
    "scored_retries": f"SELECT doc_id, 'ok' AS status, 2 AS attempts, {_SIZE} AS moderation_flagged FROM documents",
    "chat_turns": f"""SELECT conv_id, turn, 0 AS msg_index, 'system' AS role, md5({S(R.SYSTEM_PROMPT)}) AS content_md5 FROM conversations WHERE role = 'user'
      UNION ALL SELECT conv_id, turn, 1, 'user', md5({O.echo('text', 'CAST(NULL AS INTEGER)')}) FROM conversations WHERE role = 'user'
      UNION ALL SELECT conv_id, turn, 0, role, md5(text) FROM conversations WHERE role <> 'user' OR role IS NULL""",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, CAST(count(*) AS BIGINT) AS n FROM {t}" for t in ("documents", "labels", "conversations")),
}
