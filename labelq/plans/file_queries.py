"""Registered queries that write files to the shared folder and read them back: sinks, sheets, reports and optional sources as a user meets them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelq.functions import normalize as N
from labelq.functions import parsers as P
from labelq.functions.prompts import chat_messages
from labelq.operators import agreement as AG
from labelq.operators import metrics as M
from labelq.operators.resolve import resolve_final, step_counts
from labelq.operators.scoring import RateLimited, batch_score
from labelq.plans import queries as Q
from labelq.plans import roles as R
from labelq.session import scratch_path
from labelq.sources.by_header import Field, read_by_header
from labelq.sources.io import (
    assemble,
    clustered,
    figure,
    read_csv,
    read_optional,
    read_templates,
    sections,
    with_bom_header,
    write_csv,
    write_json,
    write_text,
)


def rater_sheet(spark, sf):
    """P1 + P5 + P6 + K2 + S4: the sheet handed to raters, one blank column each, written with a byte order mark and read back by header."""
    d = R.table(spark, sf, "documents").select("source", "doc_id", "lang")
    names = [AG.flag_col(r) for r in R.RATERS]
    sheet = N.add_blank_columns(N.add_blank_columns(d, names[:2]), [*names, "lang"])
    sheet = N.select_present(sheet, ["doc_id", "lang", "not there", *names])
    path = scratch_path(spark, "sheet")
    write_csv(with_bom_header(sheet), path)
    rows = read_by_header(spark, path, [Field("doc_id", "bigint"), Field("lang"), *[Field(n, "boolean") for n in names]]).rows
    blank = reduce(lambda a, b: a + b, [F.col(n).isNull().cast("int") for n in names])
    return rows.select("doc_id", "lang", blank.alias("n_blank"))


def rater_files(spark, sf):
    """J4 + P10 + P20 + P21: a file per rater, its flag column found by name, rows without an id dropped, joined to the first rater's items."""
    sheets = R.rater_sheets(spark, sf)
    parts = []
    for i, r in enumerate(R.RATERS):
        mine = sheets.where(F.col("rater") == r)
        if i == 1:
            mine = mine.where(F.col("doc_id") % 5 != 0)  # what this rater left out
        key = F.when(F.col("doc_id") % 50 == 3, F.lit(None)).otherwise(F.col("doc_id")) if i == 2 else F.col("doc_id")
        path = scratch_path(spark, f"rater_{r}")
        write_csv(mine.select(F.col("raw_flag").alias(f"{r}_flag"), key.alias("ID")), path)
        back = read_by_header(spark, path, [Field("ID", "bigint"), Field(f"{r}_flag")]).rows
        found = N.columns_matching(back, "_flag")
        N.check_rater_columns(back, "_flag", [r])
        kept, _ = N.drop_null_keys(back, ["ID"], f"rater_{r}")
        parts.append(kept.select(F.col("ID").alias("doc_id"), F.lit(r).alias("rater"), F.col(found[0]).alias("raw_flag")))
    return AG.merge_raters(reduce(DataFrame.unionByName, parts), R.RATERS, how="left")


def metrics_json(spark, sf):
    """K3: metrics as JSON lines, read back under their schema."""
    m = Q.metrics_by_run(spark, sf)
    path = scratch_path(spark, "metrics")
    write_json(m, path)
    return spark.read.schema(m.schema).json(path)


def run_reports(spark, sf):
    """K4: a report per run, of a title, gate, matrix and figures sections for the gated runs, and of a title and score table for the
    scoring runs; one text file each, read back whole."""
    run = ["run"]
    gate = Q.gate_analysis(spark, sf).withColumn("run", F.concat(F.lit("gate "), "source"))
    c = F.col
    parts = [
        sections(gate, run, 0, [c("run"), "-" * 30]),
        sections(gate, run, 1, ["Phase 1 Filtering Analysis:", figure("Filtered", c("filtered_total")), figure("Ambiguous among filtered", c("filtered_ambiguous")),
                                figure("Success rate", c("filter_success_rate"), 4), figure("Risk rate", c("filter_risk_rate"), 4)]),
        sections(gate, run, 2, ["Confusion Matrix:", figure("TP / FN", F.concat_ws(" / ", "tp", "fn")), figure("FP / TN", F.concat_ws(" / ", "fp", "tn"))]),
        sections(gate, run, 3, [figure(n, c(n.lower()), 4) for n in ("Accuracy", "Precision", "Recall", "F1")]),
    ]
    table = Q.score_crosstab(spark, sf).withColumn("run", F.concat(F.lit("score "), "run"))
    parts.append(sections(table.select("run").distinct(), run, 0, [c("run"), "-" * 30]))
    line = F.concat_ws(" ", F.lpad(c("predicted_score").cast("string"), 2, " "), c("True").cast("string"), c("False").cast("string"), c("Total").cast("string"))
    scores = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("predicted_score", line.alias("line")))), lambda s: s["line"]), "\n")
    parts.append(sections(table.groupBy("run").agg(scores.alias("scores")), run, 1, ["Score True False Total:", c("scores")]))
    reports = assemble(reduce(DataFrame.unionByName, parts), run)
    path = scratch_path(spark, "reports")
    clustered(reports, ["run"]).write.partitionBy("run").text(path)
    return spark.read.text(path, wholetext=True).select("run", F.rtrim(F.col("value"), F.lit("\n")).alias("report"))


def split_sinks(spark, sf):
    """K6 + K7 + K9: one pass each into a folder per quadrant, per target slot and per category, counted as read back."""
    quadrants = Q.quadrant_rows(spark, sf).select(F.col("quadrant").alias("part"), "doc_id")
    slots = Q.slot_augment(spark, sf).where(F.col("added_info").isNotNull()).select(F.col("target").alias("part"), "doc_id", "added_info")
    cats = Q.categorical_any(spark, sf)
    arr = F.array(*[F.struct(F.lit(n).alias("part"), F.col(f"pred_{n}").alias("pred")) for n in R.CATEGORIES])
    out = []
    for name, rows in (("quadrant", quadrants), ("slot", slots), ("category", cats.select("doc_id", F.inline(arr)))):
        path = scratch_path(spark, name)
        write_csv(rows.where(F.col("part").isNotNull()), path, partition_by=["part"])
        back = read_csv(spark, path, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("x", T.StringType()), T.StructField("part", T.StringType())]))
        out.append(back.groupBy(F.lit(name).alias("sink"), "part").agg(F.count("doc_id").alias("n"), F.sum("doc_id").alias("id_sum")))
    return reduce(DataFrame.unionByName, out)


#: Templates kept as files, by name.
TEMPLATES = {"v01_classify": R.TEMPLATE_CLASSIFY, "v02_fewshot": R.TEMPLATE_FEWSHOT}


def template_prompts(spark, sf):
    """S7 + K8 + F9: templates read from files whole, prompts assembled from the one each item names, and saved next to it."""
    root = scratch_path(spark, "templates")
    for name, text in TEMPLATES.items():
        write_text(spark.range(1).select(F.lit(f"\n{text}  \n")), f"{root}/{name}.txt")
    # A written file is a folder of part files: the template's name is the folder's.
    t = read_templates(spark, f"{root}/*.txt").select(F.regexp_extract("path", r"([^/]+)\.txt/", 1).alias("name"), "template")
    names = F.array(*[F.lit(n) for n in TEMPLATES])
    x = R.items_with_label(spark, sf).withColumn("name", F.element_at(names, (F.col("doc_id") % len(TEMPLATES) + 1).cast("int")))
    prompt = F.replace(F.replace(F.col("template"), F.lit("{text}"), F.col("text")), F.lit("{label}"), N.label_text(F.col("label")))
    prompts = x.join(t, "name").select("doc_id", "name", prompt.alias("prompt"))
    path = scratch_path(spark, "prompts")
    prompts.write.parquet(path)
    return spark.read.parquet(path).select("doc_id", "name", F.md5(F.encode("prompt", "UTF-8")).alias("prompt_md5"))


def optional_steps(spark, sf):
    """S8 + J8 + A15: the manual step has no file, so no row comes from it."""
    a, step2, _ = Q._steps(spark, sf)
    absent = read_optional(spark, scratch_path(spark, "no such step"), T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("final_manual_sent", T.StringType()), T.StructField("_pos", T.LongType())]))
    return step_counts(resolve_final(a, step2, absent))


def categorical_metrics(spark, sf):
    """M7 + A14 + A9 / A10: every category's detector, and any of them, against the truth, with the number detected."""
    truth = Q._votes(spark, sf).select("doc_id", "gt_majority")
    x = Q.categorical_any(spark, sf).join(truth, "doc_id")
    arr = F.array(*[F.struct(F.lit(n).alias("detector"), F.col(c).alias("pred")) for n, c in
                    [*[(c, f"pred_{c}") for c in R.CATEGORIES], ("any", "pred_is_ambiguous")]])
    agg = x.select("gt_majority", F.inline(arr)).groupBy("detector").agg(F.count_if("pred").alias("n_detected"), *M.confusion_aggs("gt_majority", "pred"))
    return M.with_metrics(agg)


class _LimitedOnce:
    """Stand-in for a service at its rate limit: the first call with given texts is refused, the second answered."""

    def __init__(self):
        self.seen = set()

    def __call__(self, texts: list) -> list:
        key = hash(tuple(texts))
        if key not in self.seen:
            self.seen.add(key)
            raise RateLimited()
        return Q.length_moderation_scorer(texts)


def scored_retries(spark, sf):
    """M2: calls refused at first are repeated whole after the wait; no row is lost and each tells its attempts."""
    x = R.table(spark, sf, "documents").select("doc_id", "text")
    s = batch_score(x, "text", ["doc_id"], _LimitedOnce(), Q.MODERATION_FIELDS, pause_s=0.0, sleep=lambda _s: None)
    return s.select("doc_id", "status", "attempts", "moderation_flagged")


def chat_turns(spark, sf):
    """F14 over turns of every role: a user turn becomes the system message and the rendered prompt, other turns are passed as they are."""
    c = R.table(spark, sf, "conversations")
    rendered = chat_messages(R.SYSTEM_PROMPT, R.echo_prompt(F.col("text"), F.lit(None).cast("int")))
    passed = F.array(F.struct(F.col("role").alias("role"), F.col("text").alias("content")))
    msgs = F.when(F.col("role") == "user", rendered).otherwise(passed)
    return c.select("conv_id", "turn", F.posexplode(msgs).alias("msg_index", "m")).select(
        "conv_id", "turn", "msg_index", F.col("m.role").alias("role"), F.md5(F.encode("m.content", "UTF-8")).alias("content_md5"))


def table_counts(spark, sf):
    """Rows of every table, observed by the job that writes it on, without a scan of their own."""
    counts = []
    for name in ("documents", "labels", "conversations"):
        rows, seen = N.observe_rows(R.table(spark, sf, name), f"rows of {name}")
        rows.write.format("noop").mode("overwrite").save()
        counts.append((name, seen.get["rows"]))
    return spark.createDataFrame(counts, "name string, n long")


QUERIES = {f.__name__: f for f in (
    rater_sheet, rater_files, metrics_json, run_reports, split_sinks, template_prompts, optional_steps, categorical_metrics, scored_retries, chat_turns, table_counts)}
