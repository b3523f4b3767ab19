"""Registered queries: one function (spark, sf_dir) -> DataFrame per operator group of
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelq.functions import normalize as N
from labelq.functions import parsers as P
from labelq.functions.prompts import FEWSHOT_HEAD, SLOTS, chat_messages, fewshot_item, render_format, slot_prompt
from labelq.functions.rules import KEYWORD_RULES, stand_in_scorer
from labelq.operators import agreement as AG
from labelq.operators import metrics as M
from labelq.operators.ids import dense_ids, pair_join, pair_lookup, pair_missing, range_levels
from labelq.operators.resolve import resolve_final, step_counts, subset_by_ids
from labelq.operators.sampling import (
    SEED,
    head_n,
    order_key,
    sample_n,
    shuffle_renumber,
    split_summary,
    stratified_sample,
    train_test_split,
)
from labelq.operators.scoring import ServiceError, batch_score, gated_scoring
from labelq.operators.vocab import extract_entities, extract_terms, vocab_long
from labelq.plans import roles as R
from labelq.plans.constants import GATE_PHASES, GATED_RESPONSE
from labelq.session import scratch_path, ship_package
from labelq.sources.by_header import Field, read_by_header
from labelq.sources.encodings import read_csv_any_encoding
from labelq.sources.io import read_in_order, write_csv, write_ordered, write_text
from labelq.sources.tree import read_partitioned_results, read_result_tree

Query = Callable[[SparkSession, str], DataFrame]


# --- moderation quadrants, enrichment, gate (stage 02 / 04) ---------------------------------


def quadrant_rows(spark, sf):
    x = R.labelled(spark, sf)
    q = M.quadrant(F.col("label"), F.col("flagged"))
    return x.select(
        "doc_id", "label", F.col("flagged").alias("moderation_flagged"), q.alias("quadrant"),
        (q == "A").alias("is_ambiguous_candidate"), (q == "B").alias("is_contextual_safety"),
    )


def quadrant_counts(spark, sf):
    return quadrant_rows(spark, sf).groupBy("quadrant").agg(F.count(F.lit(1)).alias("n"))


def _moderation(spark, sf) -> DataFrame:
    lab = R.table(spark, sf, "labels")
    return lab.select(
        N.to_number(F.col("doc_id")).alias("ID"),
        (F.lit(1) - F.col("quality")).alias("original_label"),
        N.to_bool_lenient(R.raw_flag_text(F.col("toxic"), F.col("doc_id"))).alias("moderation_flagged"),
    )


def moderation_enrich(spark, sf):
    d = R.table(spark, sf, "documents").select(N.to_number(F.col("doc_id")).alias("doc_id"))
    m = _moderation(spark, sf).withColumn("_m", F.lit(True))
    j = d.join(m, d.doc_id == m.ID, "left")
    return j.select(
        "doc_id",
        F.coalesce(F.col("original_label"), F.lit(0)).alias("original_label"),
        F.coalesce(F.col("moderation_flagged"), F.lit(False)).alias("moderation_flagged"),
        F.col("_m").isNotNull().alias("matched"),
    )


def _votes(spark, sf) -> DataFrame:
    merged = AG.merge_raters(R.rater_sheets(spark, sf), R.RATERS)
    return AG.with_votes(merged, R.RATERS)


def gate_analysis(spark, sf):
    """P14 + P19 + M5 + A12 + A9/A10 per model in one scan and one aggregate: gated rows
    (label 1 and flagged; unmatched moderation = label 0, not flagged) are predicted False
    without reaching the parser; the rest are parsed."""
    parsed = R.responses(spark, sf).select("doc_id", "source", P.parse_verdict(F.col("response")).alias("verdict"))
    x = parsed.join(R.labels(spark, sf), "doc_id", "left")
    label = F.coalesce(F.col("label"), F.lit(0))
    flagged = F.coalesce(N.to_bool_lenient(R.raw_flag_text(F.col("toxic"), F.col("doc_id"))), F.lit(False))
    gated = (label == 1) & flagged
    truth = _votes(spark, sf).select("doc_id", "gt_majority")
    rows = x.select(
        "doc_id", "source", gated.alias("gated"), F.when(gated, F.lit(False)).otherwise(F.col("verdict")).alias("pred_is_ambiguous"),
    ).join(truth, "doc_id")  # items without a truth are in no denominator
    rows = rows.withColumnRenamed("gt_majority", "gt_is_ambiguous")
    agg = rows.groupBy("source").agg(
        *M.gate_aggs("gated", "gt_is_ambiguous"), *M.confusion_aggs("gt_is_ambiguous", "pred_is_ambiguous")
    )
    return M.with_metrics(M.with_gate_rates(agg)).select(
        "source", "filtered_total", "filtered_ambiguous", "filter_success_rate", "filter_risk_rate",
        "tp", "fn", "fp", "tn", "n", "accuracy", "precision", "recall", "f1",
    )


# --- normalisers and names ------------------------------------------------------------------


def bool_normalise(spark, sf):
    x = R.items_with_label(spark, sf)
    raw = R.raw_flag_text(F.col("toxic"), F.col("doc_id"))
    return x.select(
        "doc_id", raw.alias("raw_flag"),
        N.to_bool_lenient(raw).alias("flag_lenient"), N.to_bool_strict(raw).alias("flag_strict"),
    )


def strict_flag_map(spark, sf):
    x = R.labelled(spark, sf)
    flag = N.to_bool_strict(R.raw_flag_text(F.col("toxic"), F.col("doc_id")))
    return (
        x.select(M.quadrant(F.col("label"), flag).alias("quadrant"))
        .groupBy("quadrant")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def label_text(spark, sf):
    x = R.items_with_label(spark, sf)
    return x.select(
        "doc_id", "label", N.label_text(F.col("label")).alias("label_text"),
        N.label_text_strict(F.col("label")).alias("label_text_strict"),
    )


def safe_name(spark, sf):
    d = R.table(spark, sf, "documents")
    model = F.concat(F.lit("org-"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("-instruct"))
    path = F.concat(
        F.lit("prompts/"), F.col("lang"), F.lit("/v0"), ((F.col("doc_id") % 5) + 1).cast("string"), F.lit("_base.txt")
    )
    return d.select(
        "doc_id", model.alias("model_id"), N.safe_name(model).alias("safe_model"),
        N.base_name(model).alias("model_base"), N.stem_name(path).alias("prompt_name"),
    )


# --- parsers F1-F8 --------------------------------------------------------------------------


def parse_label(spark, sf):
    r = R.responses(spark, sf)
    lab = P.parse_label(F.col("response"))
    return r.select("doc_id", lab.alias("predicted_label"), (lab == -1).alias("parse_error"))


def parse_verdict(spark, sf):
    return R.responses(spark, sf).select("doc_id", P.parse_verdict(F.col("response")).alias("pred_is_ambiguous"))


def parse_bracket(spark, sf):
    return R.responses(spark, sf).select("doc_id", P.parse_bracket(F.col("response")).alias("pred_bracket"))


def parse_stepwise(spark, sf):
    return R.responses(spark, sf).select("doc_id", P.parse_stepwise(F.col("response")).alias("pred_stepwise"))


def parse_score(spark, sf):
    return R.responses(spark, sf).select("doc_id", P.parse_score(F.col("response")).alias("predicted_score"))


def parse_yes_no(spark, sf):
    r = R.responses(spark, sf).select("doc_id", P.parse_yes_no(F.col("response")).alias("p"))
    return r.select("doc_id", F.col("p.decision").alias("decision"), F.col("p.text").alias("added_info"))


def strip_echo(spark, sf):
    r = R.responses(spark, sf)
    rewrite = P.strip_heading(F.concat(F.lit(R.HEADING_PREFIX), F.col("response")))
    return r.select("doc_id", "response", rewrite.alias("rewrite"))


# --- prompt rendering F9-F14 ----------------------------------------------------------------


def render_prompt(spark, sf):
    x = R.items_with_label(spark, sf)
    return x.select("doc_id", R.echo_prompt(F.col("text"), F.col("label")).alias("prompt"))


def _pairs(spark, sf) -> DataFrame:
    x = R.items_with_label(spark, sf).select("doc_id", F.col("text").alias("sent"), "label")
    p = pair_join(x, "doc_id", ["sent", "label"])
    return p.select(
        "doc_id",
        F.col("sent").alias("target_sent"),
        F.col("label").alias("target_label"),
        "pair_id",
        "pair_sent",
        "pair_label",
        N.label_text_strict(F.col("label")).alias("target_label_str"),
        N.label_text_strict(F.col("pair_label")).alias("pair_label_str"),
    )


def render_named(spark, sf):
    p = _pairs(spark, sf)
    prompt = render_format(
        R.TEMPLATE_PAIR,
        target_sent=F.col("target_sent"), target_label_str=F.col("target_label_str"),
        pair_sent=F.col("pair_sent"), pair_label_str=F.col("pair_label_str"),
    )
    return p.select("doc_id", prompt.alias("prompt"))


def _slot_rows(spark, sf) -> DataFrame:
    """J9 rows x slots as a generator over a 3-entry literal array (no join)."""
    x = R.items_with_label(spark, sf)
    slots = F.explode(F.array(*[F.lit(s) for s in SLOTS]))
    x = x.select("doc_id", "text", "label", slots.alias("target"))
    prompt = None
    for s in SLOTS:
        p = slot_prompt(s, F.col("text"), F.col("label"), R.TEMPLATE_SLOT)
        prompt = F.when(F.col("target") == s, p) if prompt is None else prompt.when(F.col("target") == s, p)
    return x.select("doc_id", "target", prompt.alias("prompt"))


def slot_prompts(spark, sf):
    return _slot_rows(spark, sf)


def _fewshot_block(spark, sf) -> DataFrame:
    """3 + 3 shots drawn by seed from the labelled pool, formatted in drawn order.
    One row whose size is bounded by six texts."""
    v = _votes(spark, sf).select("doc_id", "gt_majority")
    pool = R.labelled(spark, sf).select("doc_id", "text", "label").join(v, "doc_id")
    shots = stratified_sample(pool, "doc_id", "gt_majority", {True: 3, False: 3})
    items = shots.select(
        order_key(F.col("doc_id"), SEED + 1).alias("ord"),
        fewshot_item(F.col("text"), F.col("label"), F.col("gt_majority")).alias("item"),
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "item"))), lambda s: s["item"]), "")
    return items.agg(F.concat(F.lit(FEWSHOT_HEAD), F.coalesce(joined, F.lit(""))).alias("block"))


def fewshot_block(spark, sf):
    b = R.table(spark, sf, "benchmark")
    block = _fewshot_block(spark, sf).scalar()
    prompt = F.concat(block, F.lit("\n"), render_format(R.TEMPLATE_FEWSHOT, text=F.col("text")))
    return b.select("item_id", prompt.alias("prompt"))


def chat_messages_q(spark, sf):
    c = R.table(spark, sf, "conversations").where(F.col("role") == "user")
    msgs = chat_messages(R.SYSTEM_PROMPT, R.echo_prompt(F.col("text"), F.lit(None).cast("int")))
    return c.select("conv_id", "turn", F.posexplode(msgs).alias("msg_index", "m")).select(
        "conv_id", "turn", "msg_index", F.col("m.role").alias("role"), F.col("m.content").alias("content")
    )


# --- agreement A1-A8 ------------------------------------------------------------------------


def rater_merge(spark, sf):
    return AG.merge_raters(R.rater_sheets(spark, sf), R.RATERS)


def votes(spark, sf):
    return _votes(spark, sf).select("doc_id", "votes", "vote_ratio", "n_raters", "gt_majority", "gt_union")


def agreement_report(spark, sf):
    return AG.agreement_report(_votes(spark, sf), R.RATERS)


def cohen_pairs(spark, sf):
    return AG.cohen_pairs(_votes(spark, sf), R.RATERS)


def fleiss(spark, sf):
    return AG.fleiss_report(_votes(spark, sf), R.RATERS)


# --- predictions, confusion, metrics, re-evaluation (A9-A13, J3) -----------------------------


def _predictions(spark, sf) -> DataFrame:
    """Predictions of several runs, one row per item: model = source, methods classification
    (F2), stepwise (F4), scoring (F5, score >= 5; unscored rows are dropped later). Carries a
    stale truth column, as result files do."""
    r = R.responses(spark, sf)
    return r.select(
        "doc_id",
        F.col("source").alias("model"),
        F.lit(False).alias("gt_majority"),
        P.parse_verdict(F.col("response")).alias("pred_classification"),
        P.parse_stepwise(F.col("response")).alias("pred_stepwise"),
        (P.parse_score(F.col("response")) >= 5).alias("pred_scoring"),
    )


METHODS = ("classification", "stepwise", "scoring")
GT_TYPES = ("gt_majority", "gt_union")


def _reevaluated(spark, sf) -> DataFrame:
    """Drop stale truth, left join the latest truth (one row per item crosses the
    shuffle), then one generator stacks methods x truth types."""
    preds = _predictions(spark, sf).drop("gt_majority", "gt_union")
    truth = _votes(spark, sf).select("doc_id", *GT_TYPES)
    j = preds.join(truth, "doc_id", "left")
    runs = F.array(
        *[
            F.struct(
                F.lit(m).alias("method"), F.col(f"pred_{m}").alias("pred"),
                F.lit(g).alias("gt_type"), F.col(g).alias("truth"),
            )
            for m in METHODS
            for g in GT_TYPES
        ]
    )
    out = j.select("model", F.lit(R.MODEL_PROMPT).alias("prompt"), F.inline(runs))
    return out.where(F.col("pred").isNotNull())


def result_tree(spark, sf):
    """K5 + S6 round trip: predictions written as a model= / method= / prompt= CSV tree under
    the shared checkpoint folder, read back with partition discovery and a method filter
    (partition pruning)."""
    runs = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"pred_{m}").alias("pred")) for m in METHODS])
    long = _predictions(spark, sf).select("doc_id", "model", F.lit(R.MODEL_PROMPT).alias("prompt"), F.inline(runs))
    root = scratch_path(spark, "result_tree", sf.rstrip("/").rsplit("/", 1)[-1])
    write_csv(long, root, partition_by=["model", "method", "prompt"])
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("pred", T.BooleanType())])
    back = read_partitioned_results(spark, root, schema, methods=["classification", "stepwise"])
    return back.select("doc_id", "model", "method", "prompt", "pred")


def _layouts() -> dict[str, list[tuple[str, Column]]]:
    """The result layout of each method, as (column, value) of a response row."""
    key, response = F.col("doc_id"), F.col("response")
    truth = F.lit("False")  # stale
    verdict = P.parse_verdict(response)
    shown = lambda c: F.initcap(c.cast("string"))
    return {
        "classification": [("Original_ID", key), ("gt_is_ambiguous", truth),
                           ("pred_is_ambiguous", F.when(key % 97 == 0, F.lit("unclear")).otherwise(shown(verdict))), ("phase", F.lit("llm"))],
        "scoring": [("predicted_score", P.parse_score(response).cast("double")), ("Original_ID", key), ("gt_majority", truth)],
        "stepwise": [("Original_ID", key), ("llm_raw_response", response), ("gt_is_ambiguous", truth),
                     ("pred_is_ambiguous", F.upper(P.parse_stepwise(response).cast("string")))],
        "fewshot": [("response_text", F.concat(F.lit('"'), F.col("source"), F.lit('",\n'))), ("pred_is_ambiguous", shown(P.parse_bracket(response))),
                    ("Original_ID", key.cast("double"))],
    }


RESULT_FIELDS = [
    Field("Original_ID", "bigint"), Field("pred_is_ambiguous", "boolean", required=False), Field("predicted_score", "int", required=False),
    Field("response", required=False, aliases=("llm_raw_response", "response_text")),
]


def result_layouts(spark, sf):
    """S1 + S6 + K5: every method's results in a layout of its own (other columns, other order, numbers written as 5.0, one unreadable value), written
    to one result tree and read back by header; scores of 5 and more predict True."""
    r = R.responses(spark, sf)
    root = scratch_path(spark, "layouts")
    for method, columns in _layouts().items():
        rows = r.select(*[c.alias(n) for n, c in columns], F.col("source").alias("model"), F.lit(method).alias("method"), F.lit(R.MODEL_PROMPT).alias("prompt"))
        write_csv(rows, root, mode="append", partition_by=["model", "method", "prompt"])
    back = read_result_tree(spark, root, RESULT_FIELDS)
    return back.select(
        F.col("Original_ID").alias("doc_id"), "model", "method", "prompt", "predicted_score",
        F.when(F.col("method") == "scoring", F.col("predicted_score") >= 5).otherwise(F.col("pred_is_ambiguous")).alias("pred"),
        F.md5(F.encode("response", "UTF-8")).alias("response_md5"), F.size("_bad").alias("n_bad"))


def _confusion_with_unmatched(df: DataFrame, keys: list[str]) -> DataFrame:
    # unmatched truth goes to a count and out of the matrix (null rule 5, documented deviation)
    matched = F.col("truth").isNotNull()
    return df.groupBy(*keys).agg(
        F.count_if(matched & F.col("truth") & F.col("pred")).alias("tp"),
        F.count_if(matched & F.col("truth") & ~F.col("pred")).alias("fn"),
        F.count_if(matched & ~F.col("truth") & F.col("pred")).alias("fp"),
        F.count_if(matched & ~F.col("truth") & ~F.col("pred")).alias("tn"),
        F.count_if(matched).alias("n"),
        F.count_if(~matched).alias("n_unmatched"),
    )


def confusion_by_run(spark, sf):
    return _confusion_with_unmatched(_reevaluated(spark, sf), ["model", "method", "prompt", "gt_type"])


def metrics_by_run(spark, sf):
    x = _reevaluated(spark, sf).where(F.col("gt_type") == "gt_majority")
    return M.with_metrics(_confusion_with_unmatched(x, ["model", "method", "prompt"]))


def reevaluate(spark, sf):
    return M.with_metrics(_confusion_with_unmatched(_reevaluated(spark, sf), ["model", "method", "prompt", "gt_type"]))


def metrics_both_denominators(spark, sf):
    """Zero-shot label metrics (F1, A10, A11) with both denominators: parse errors counted
    wrong (all rows) and left out (valid rows)."""
    r = R.responses(spark, sf).select("doc_id", "source", P.parse_label(F.col("response")).alias("p"))
    x = r.join(R.labels(spark, sf).where(F.col("label").isNotNull()), "doc_id").select("source", (F.col("label") == 1).alias("y"), "p")
    valid = F.col("p") != -1
    yp = F.col("p") == 1
    agg = x.groupBy(F.col("source").alias("model")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(valid).alias("n_valid"),
        F.count_if(~valid).alias("n_parse_error"),
        F.count_if(valid & (F.col("y") == yp)).alias("n_correct"),
        F.count_if(valid & F.col("y") & yp).alias("tp"),
        F.count_if(valid & ~F.col("y") & yp).alias("fp"),
        F.count_if(valid & F.col("y") & ~yp).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return agg.withColumns(
        {
            "accuracy_all": M.ratio(F.col("n_correct"), F.col("n")),
            "accuracy_valid": M.ratio(F.col("n_correct"), F.col("n_valid")),
            "precision": M.ratio0(tp, tp + fp),
            "recall": M.ratio0(tp, tp + fn),
            "f1": M.ratio0(tp * 2, tp * 2 + fp + fn),
            "parse_error_rate": M.ratio(F.col("n_parse_error"), F.col("n")),
        }
    )


def confusion_split(spark, sf):
    r = R.responses(spark, sf).select("doc_id", P.parse_verdict(F.col("response")).alias("pred_is_ambiguous"))
    truth = _votes(spark, sf).select("doc_id", F.col("gt_majority").alias("gt_is_ambiguous"))
    x = truth.join(r, "doc_id")
    return x.withColumn("cell", M.confusion_cell(F.col("gt_is_ambiguous"), F.col("pred_is_ambiguous")))


def score_crosstab(spark, sf):
    return M.score_crosstab(R.score_events(spark, sf), ["run"], "predicted_score", "gt_is_ambiguous")


def score_threshold_metrics(spark, sf):
    e = R.score_events(spark, sf).where(F.col("predicted_score").isNotNull())
    x = e.withColumn("pred", F.col("predicted_score") >= 5)
    return M.confusion_by(x, ["run"], "gt_is_ambiguous", "pred")


def score_histogram(spark, sf):
    return M.score_histogram(R.score_events(spark, sf), ["run"], "predicted_score", "gt_is_ambiguous")


def _categorical(spark, sf) -> DataFrame:
    """J9 + F3 + P18: three category prompts per item, combined per item without a shuffle."""
    d = R.table(spark, sf, "documents").select("doc_id", "text")
    preds = {
        f"pred_{c}": P.parse_bracket(R.reply_for(F.col("doc_id"), F.col("text"), offset=i + 1))
        for i, c in enumerate(R.CATEGORIES)
    }
    x = d.select("doc_id", *[v.alias(k) for k, v in preds.items()])
    return x.withColumn("pred_is_ambiguous", N.any_of_present(x, list(preds)))


def categorical_any(spark, sf):
    return _categorical(spark, sf)


def categorical_counts(spark, sf):
    x = _categorical(spark, sf)
    arr = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"pred_{c}").alias("pred")) for c in R.CATEGORIES])
    return (
        x.select(F.inline(arr))
        .groupBy("category")
        .agg(F.count_if(F.col("pred")).alias("n_true"), F.count(F.lit(1)).alias("n"))
    )


# --- ids, sampling, splits (P4, O2-O5, U2, A19) ---------------------------------------------


def sample_n_q(spark, sf):
    d = R.table(spark, sf, "documents").select("doc_id", "lang")
    return sample_n(d, "doc_id", 100)


def shuffle_ids(spark, sf):
    d = R.table(spark, sf, "documents").select("doc_id")
    return shuffle_renumber(d, "doc_id")


def _class_pool(spark, sf) -> DataFrame:
    return _votes(spark, sf).select("doc_id", "gt_majority")


def stratified_train(spark, sf):
    return stratified_sample(_class_pool(spark, sf), "doc_id", "gt_majority", {True: 5, False: 95})


def train_test(spark, sf):
    _, test = train_test_split(_class_pool(spark, sf), "doc_id", "gt_majority", {True: 5, False: 95})
    return test


def split_summary_q(spark, sf):
    train, test = train_test_split(_class_pool(spark, sf), "doc_id", "gt_majority", {True: 5, False: 95})
    return split_summary(train, test, "gt_majority")


def head_n_q(spark, sf):
    return head_n(R.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 10)


def union_renumber(spark, sf):
    """S2 + U1 + P2 + P4: raw parts (one per language, in name order) unioned, a stale
    column dropped, fresh 1-based Original_ID in (part, position) order."""
    d = R.table(spark, sf, "documents").drop("text", "n_chars")
    return dense_ids(d, ["lang", "doc_id"], [F.col("lang"), *range_levels("doc_id")], id_col="Original_ID")


#: Fixed values of our own: the raw parts of a corpus, their columns in the order of each file, and one file that is not there.
RAW_PARTS = {
    "data_train": ("en", ["Unnamed: 0", "doc_id", "lang", "source"]),
    "data_val": ("de", ["source", "doc_id", "lang"]),
    "data_test": ("fr", ["lang", "note", "source", "doc_id"]),
    "data_extra": ("es", ["doc_id", "source", "lang", "Unnamed: 0"]),
}


#: Fixed values of our own: the encoding in which each language's raw file is written, with a character that no encoding tried before it has.
RAW_ENCODINGS = {"en": ("utf-8", "é"), "de": ("shift_jis", "文"), "fr": ("cp932", "①"), "es": ("euc-jp", "癰")}


def _raw_csv(encoding: str):
    """Task that writes (doc_id, sent) as CSV lines in ``encoding``; every part file begins with the header."""
    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([b"doc_id,sent"], pa.binary())], names=["line"])
        for batch in batches:
            lines = [f'{i},"{t.replace(chr(34), chr(34) * 2)}"'.encode(encoding) for i, t in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], names=["line"])

    return run


def read_encodings(spark, sf):
    """S3 + S1: the texts of four languages as CSV in four encodings (ASCII characters only, but for one that gives the encoding away), read back in
    byte ranges with the encoding found per file."""
    ship_package(spark)
    d = R.table(spark, sf, "documents").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    root = scratch_path(spark, "encoded")
    for lang, (encoding, mark) in RAW_ENCODINGS.items():
        # The reader takes a line break of either kind within quotes; NUL is no character of a text file.
        text = F.regexp_replace(F.regexp_replace("text", "[^\\x01-\\x7F]", ""), "\r", "")
        rows = d.where(F.col("lang") == lang).select("doc_id", F.concat(F.lit(mark), text).alias("sent"))
        lines = rows.mapInArrow(_raw_csv(encoding), "line binary").select(F.col("line").cast("string").alias("value"))
        write_text(lines, f"{root}/{lang}")
    rows = read_csv_any_encoding(spark, f"{root}/*", [Field("doc_id", "bigint"), Field("sent")], glob="part-*")
    return rows.select("doc_id", F.col("_encoding").alias("encoding"), F.md5(F.encode("sent", "UTF-8")).alias("sent_md5"), F.size("_bad").alias("n_bad"))


def union_files(spark, sf):
    """S1 + S2 + S5 + U1 + P2 + P4: raw CSV parts with columns of their own order, stale extra columns and one missing part, bound by header,
    unioned in path order and numbered from 1 in (part, doc_id) order."""
    d = R.table(spark, sf, "documents").select("doc_id", "lang", "source")
    extra = {"Unnamed: 0": F.col("doc_id") - 1, "note": F.concat(F.lit('said "'), F.col("source"), F.lit('",\nthen left'))}
    root, paths = scratch_path(spark, "raw"), []
    for name, (lang, columns) in RAW_PARTS.items():
        paths.append(f"{root}/{name}.csv")
        part = d.where(F.col("lang") == lang).withColumns(extra)
        write_csv(part.select(*columns), paths[-1])
    fields = [Field("doc_id", "bigint"), Field("language", aliases=("lang",)), Field("source")]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        rows = read_by_header(spark, [paths[0], f"{root}/data_missing.csv", *paths[1:]], fields, on_unreadable="skip").rows
    rows = rows.select("doc_id", "language", "source", F.col("_part").alias("part"), F.size("_bad").alias("n_bad"))
    return dense_ids(rows, ["part", "doc_id"], [F.col("part"), *range_levels("doc_id")], id_col="Original_ID")


def ordered_sink(spark, sf):
    """O1 + O6: the rater votes written in the order of doc_id, read back with the position of every row in file order."""
    v = _votes(spark, sf).select("doc_id", "votes").where(F.col("doc_id").isNotNull())
    path = scratch_path(spark, "ordered")
    write_ordered(v, path, ["doc_id"], fmt="parquet")
    back = read_in_order(spark, path)
    out = dense_ids(back, ["_file", "_row"], [F.col("_file"), *range_levels("_row")], id_col="position")
    return out.select("doc_id", "votes", "position")


def pair_targets(spark, sf):
    """Partners of the ambiguous items only, looked up in the full table (the partner need not be ambiguous)."""
    v = _votes(spark, sf).where("gt_majority").select("doc_id")
    lookup = R.items_with_label(spark, sf).select("doc_id", F.col("text").alias("sent"), "label")
    p = pair_lookup(v, lookup, "doc_id", ["sent", "label"])
    return p.select("doc_id", "pair_id", "pair_found", "pair_sent", "pair_label", N.label_text_strict(F.col("pair_label")).alias("pair_label_str"))


def pair_join_q(spark, sf):
    return _pairs(spark, sf)


def pair_missing_q(spark, sf):
    return pair_missing(R.table(spark, sf, "documents").select("doc_id"), "doc_id")


# --- revision steps (J8, J6, A15, M8) -------------------------------------------------------

_RESPONSE_FIELD = [T.StructField("response", T.StringType())]


def _regenerated(spark, sf) -> DataFrame:
    """M8: only is_ok = 0 rows reach the scorer (the rule stand-in, in mapInPandas); the
    prompt travels through the operator, so nothing is joined back."""
    a = R.annotation(spark, sf).where(F.col("is_ok") == 0)
    q = a.select("doc_id", R.feedback_prompt(a).alias("prompt"))
    return batch_score(q, "prompt", ["doc_id"], stand_in_scorer, _RESPONSE_FIELD, pause_s=0.0, keep_text=True)


def regenerate_queue(spark, sf):
    g = _regenerated(spark, sf)
    return g.select("doc_id", "prompt", "response", P.strip_heading(F.col("response")).alias("augmented_sent_step2"), "status")


def _steps(spark, sf):
    a = R.annotation(spark, sf)
    g = _regenerated(spark, sf).select("doc_id", P.strip_heading(F.col("response")).alias("augmented_sent_step2"))
    step2 = g.withColumns(
        {"is_ok_step2": F.when(F.col("doc_id") % 2 == 0, F.lit(1)).otherwise(F.lit(0)), "_pos": F.col("doc_id")}
    )
    step3 = a.where(F.col("doc_id") % 15 == 0).select(
        "doc_id", F.concat(F.col("target_sent"), F.lit(" (manual)")).alias("final_manual_sent"), "_pos"
    )
    return a, step2, step3


def resolve_final_q(spark, sf):
    a, s2, s3 = _steps(spark, sf)
    return resolve_final(a, s2, s3)


def resolve_counts(spark, sf):
    return step_counts(resolve_final_q(spark, sf))


def resolve_subset(spark, sf):
    a, s2, s3 = _steps(spark, sf)
    ids = a.where(((F.col("doc_id") % 3) + 1).isin(1, 2)).select("doc_id")
    return step_counts(subset_by_ids(resolve_final(a, s2, s3), ids, "doc_id"))


# --- slot augmentation (M9, F6, A18) --------------------------------------------------------


def _slot_augmented(spark, sf) -> DataFrame:
    rows = _slot_rows(spark, sf)
    scored = batch_score(rows, "prompt", ["doc_id", "target"], stand_in_scorer, _RESPONSE_FIELD, pause_s=0.0)
    p = P.parse_yes_no(F.col("response"))
    keep = (p["decision"] == "YES") & (p["text"] != P.NOT_AVAILABLE)
    return scored.select("doc_id", "target", F.when(keep, p["text"]).alias("added_info"))


def slot_augment(spark, sf):
    return _slot_augmented(spark, sf)


def slot_counts(spark, sf):
    return _slot_augmented(spark, sf).groupBy("target").agg(
        F.count("added_info").alias("n_added"), F.count(F.lit(1)).alias("total")
    )


# --- vocabulary (F15-F17, A17, U3, M10) -----------------------------------------------------


def _terms(spark, sf) -> DataFrame:
    return extract_terms(R.table(spark, sf, "documents"), "text")


def vocab_pools(spark, sf):
    return vocab_long(_terms(spark, sf))


def vocab_sizes(spark, sf):
    counts = vocab_long(_terms(spark, sf)).groupBy("category").agg(F.count(F.lit(1)).alias("size"))
    cats = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c, _ in KEYWORD_RULES])).alias("category"))
    return cats.join(counts, "category", "left").select("category", F.coalesce("size", F.lit(0)).alias("size"))


def extract_entities_q(spark, sf):
    d = R.table(spark, sf, "documents")
    e = extract_entities(d, "doc_id", "text")
    return e.select("doc_id", "category", "term")


# --- batch scoring (M1-M4) ------------------------------------------------------------------

MODERATION_FIELDS = [
    T.StructField("moderation_flagged", T.BooleanType()),
    T.StructField("score_length", T.DoubleType()),
    T.StructField("score_lines", T.DoubleType()),
]


def length_moderation_scorer(texts: list) -> list:
    """Deterministic stand-in for a moderation service: category scores from text shape."""
    out = []
    for t in texts:
        t = t or ""
        n = len(t)
        lines = t.count("\n")
        s_len = n / (n + 1000.0)
        out.append({"moderation_flagged": s_len >= 0.5, "score_length": s_len, "score_lines": lines / (lines + 10.0)})
    return out


def batch_score_q(spark, sf):
    x = R.items_with_label(spark, sf).select("doc_id", "label", "text")
    s = batch_score(x, "text", ["doc_id", "label"], length_moderation_scorer, MODERATION_FIELDS, pause_s=0.0)
    q = M.quadrant(F.col("label"), F.col("moderation_flagged"))
    return s.select(
        "doc_id", "label", "moderation_flagged", "score_length", "score_lines", "status",
        F.coalesce(q == "A", F.lit(False)).alias("is_ambiguous_candidate"),
        F.coalesce(q == "B", F.lit(False)).alias("is_contextual_safety"),
    )


def _flaky_scorer(texts: list) -> list:
    """Fails for good on batches holding a text with a digit; otherwise the length scorer."""
    if any(any(ch.isdigit() for ch in (t or "")) for t in texts):
        raise ServiceError("unavailable")
    return length_moderation_scorer(texts)


def batch_score_failures(spark, sf):
    """M3: failing calls are halved down to the rows at fault, so the status of a row depends on it alone."""
    x = R.table(spark, sf, "documents").select("doc_id", "text")
    s = batch_score(x, "text", ["doc_id"], _flaky_scorer, MODERATION_FIELDS, max_retries=2, pause_s=0.0, sleep=lambda _s: None)
    return s.select("doc_id", "status", "attempts", "moderation_flagged")


def _verdict_scorer(texts: list) -> list:
    """Deterministic stand-in for a model asked for a verdict: TRUE for texts of an even number of characters."""
    return [{"response": f"考えた結果\n最終判定: {'TRUE' if len(t or '') % 2 == 0 else 'FALSE'}"} for t in texts]


def _gated(spark, sf, drop_gated: bool) -> DataFrame:
    x = R.items_with_label(spark, sf)
    flagged = F.coalesce(N.to_bool_lenient(R.raw_flag_text(F.col("toxic"), F.col("doc_id"))), F.lit(False))
    return gated_scoring(
        x, (F.col("label") == 1) & flagged, F.col("text"), ["doc_id", "source"], _verdict_scorer, _RESPONSE_FIELD,
        predict={"pred_is_ambiguous": P.parse_verdict(F.col("response")), "llm_raw_response": F.col("response")},
        constants={"pred_is_ambiguous": F.lit(False), "llm_raw_response": F.lit(GATED_RESPONSE)},
        drop_gated=drop_gated, phases=GATE_PHASES, pause_s=0.0)


def gated_predictions(spark, sf):
    """M5 + P19: one scan routes gated rows past the scorer with a fixed response; the others are scored and parsed."""
    return _gated(spark, sf, False)


def gated_scoring_q(spark, sf):
    """M5 + A9 / A10 per model in both forms: gated rows kept as predictions of False, or left out before the scorer."""
    out = None
    truth = _votes(spark, sf).select("doc_id", F.col("gt_majority").alias("gt_is_ambiguous"))
    for form, drop in (("keep", False), ("drop", True)):
        rows = _gated(spark, sf, drop).select("doc_id", "source", "pred_is_ambiguous", "phase").join(truth, "doc_id")
        got = M.with_metrics(rows.groupBy("source").agg(
            F.count_if(F.col("phase") == GATE_PHASES[0]).alias("n_gated"), *M.confusion_aggs("gt_is_ambiguous", "pred_is_ambiguous")))
        got = got.select(F.lit(form).alias("form"), "*")
        out = got if out is None else out.unionByName(got)
    return out


QUERIES: dict[str, Query] = {
    "quadrant_counts": quadrant_counts,
    "quadrant_rows": quadrant_rows,
    "moderation_enrich": moderation_enrich,
    "gate_analysis": gate_analysis,
    "bool_normalise": bool_normalise,
    "strict_flag_map": strict_flag_map,
    "label_text": label_text,
    "safe_name": safe_name,
    "parse_label": parse_label,
    "parse_verdict": parse_verdict,
    "parse_bracket": parse_bracket,
    "parse_stepwise": parse_stepwise,
    "parse_score": parse_score,
    "parse_yes_no": parse_yes_no,
    "strip_echo": strip_echo,
    "render_prompt": render_prompt,
    "render_named": render_named,
    "slot_prompts": slot_prompts,
    "fewshot_block": fewshot_block,
    "chat_messages": chat_messages_q,
    "rater_merge": rater_merge,
    "votes": votes,
    "agreement_report": agreement_report,
    "cohen_pairs": cohen_pairs,
    "fleiss": fleiss,
    "confusion_by_run": confusion_by_run,
    "metrics_by_run": metrics_by_run,
    "reevaluate": reevaluate,
    "metrics_both_denominators": metrics_both_denominators,
    "confusion_split": confusion_split,
    "score_crosstab": score_crosstab,
    "score_threshold_metrics": score_threshold_metrics,
    "score_histogram": score_histogram,
    "categorical_any": categorical_any,
    "categorical_counts": categorical_counts,
    "sample_n": sample_n_q,
    "shuffle_ids": shuffle_ids,
    "stratified_train": stratified_train,
    "train_test_split": train_test,
    "split_summary": split_summary_q,
    "head_n": head_n_q,
    "union_renumber": union_renumber,
    "pair_join": pair_join_q,
    "pair_missing": pair_missing_q,
    "pair_targets": pair_targets,
    "union_files": union_files,
    "read_encodings": read_encodings,
    "ordered_sink": ordered_sink,
    "result_layouts": result_layouts,
    "gated_predictions": gated_predictions,
    "gated_scoring": gated_scoring_q,
    "resolve_final": resolve_final_q,
    "resolve_counts": resolve_counts,
    "resolve_subset": resolve_subset,
    "regenerate_queue": regenerate_queue,
    "slot_augment": slot_augment,
    "slot_counts": slot_counts,
    "vocab_pools": vocab_pools,
    "vocab_sizes": vocab_sizes,
    "extract_entities": extract_entities_q,
    "batch_score": batch_score_q,
    "batch_score_failures": batch_score_failures,
    "result_tree": result_tree,
}
