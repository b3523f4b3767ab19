"""How the driver's tables play the reference's roles (see FIXTURES.md, part B).

- item = ``documents`` (doc_id, text); label = ``1 - labels.quality`` (1 = not acceptable);
  moderation flag = ``labels.toxic = 1``
- raters a / b / c = ``toxic = 1``, ``quality = 0``, ``n_chars < 400`` over documents join
  labels, delivered as rater sheets with free-text flags
- model reply = one of eight reply forms chosen by ``doc_id % 8``, wrapped around the
  item's whole text and appended to the echoed prompt
- score reply = ``events.value`` as text; truth = ``user_id % 2 = 0``; run = ``event_type``
- revision steps: step 2 = ``doc_id % 3 = 0`` (ok if even); step 3 = ``doc_id % 15 = 0``

Every frame here is derived from the given tables, so the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelq.functions.normalize import label_text
from labelq.functions.parsers import parse_score, strip_echo, strip_heading
from labelq.functions.prompts import render_format, render_replace

RATERS = ("a", "b", "c")
MODEL_PROMPT = "v01"

# Fixed values of our own: prompt templates (the dimension table of templates).
TEMPLATE_CLASSIFY = (
    "次の文章には「{label}」というラベルが付いています。\n文章：{text}\n"
    "判断に必要な情報が欠けていれば TRUE、そうでなければ FALSE と答えてください。"
)
TEMPLATE_PAIR = (
    "対になる二つの文章です。\n対象：{target_sent}（{target_label_str}）\n"
    "ペア：{pair_sent}（{pair_label_str}）\n対象の文章に文脈を加えてください。"
)
TEMPLATE_SLOT = (
    "文章「{text}」（ラベル {label}）に「{word}」の情報が欠けていますか。"
    "欠けていれば YES、そうでなければ NO と答え、次の行に補う情報（例: {example}）を書いてください。"
)
TEMPLATE_FEEDBACK = (
    "元の文章：{original}\n前回の文章：{previous}\nラベル：{label}\n"
    "コメント：{comment}\n「いつ」の情報を補い、YES または NO と次の行に新しい文章を書いてください。"
)
TEMPLATE_FEWSHOT = "文章：{text}\n判定："
SYSTEM_PROMPT = "あなたは文章の道徳判断を助けるアシスタントです。"
CATEGORIES = ("cat1_logic", "cat2_label", "cat3_info")

# Fixed values of our own: eight reply forms (prefix, suffix) around the item's text. Together
# they reach every branch of the parsers F1-F8.
REPLY_FORMS = [
    ("YES\n", " 許容できない"),
    ("no \n\n", "\n最終判定: FALSE"),
    ("", "\n最終判定: TRUE"),
    ("TRUE と考えた。\n最終判定：", "\nfalse"),
    ("[TRUE] ", "\n許容できる"),
    ("許容できない、いや許容できる\n", "\n最終判定 保留"),
    ("Sure.\nyes\n", "\nScore ５/10"),
    ("　", " not TRUE　"),
]
SCORE_PREFIX = "score: "
HEADING_PREFIX = "シナリオA: "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def reply_for(key: Column, text: Column, offset: int = 0) -> Column:
    k = (key + F.lit(offset)) % 8
    expr = None
    for i, (pre, suf) in enumerate(REPLY_FORMS):
        v = F.concat(F.lit(pre), text, F.lit(suf))
        expr = F.when(k == i, v) if expr is None else expr.when(k == i, v)
    return expr


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents join labels: doc_id, text, lang, source, n_chars, label, flagged."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "inner").select(
        "doc_id", "text", "lang", "source", "n_chars",
        (F.lit(1) - F.col("quality")).alias("label"),
        (F.col("toxic") == 1).alias("flagged"),
        "quality", "toxic",
    )


def items_with_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents left join labels: every item, label NULL where unlabelled."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left").select(
        "doc_id", "text", "lang", "source", "n_chars",
        (F.lit(1) - F.col("quality")).alias("label"), "toxic",
    )


def rater_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rater sheets in long form (doc_id, rater, raw_flag) with free-text flags."""
    x = labelled(spark, sf_dir)
    a = F.when(F.col("toxic") == 1, F.lit("TRUE")).otherwise(F.lit("FALSE"))
    b = F.when(F.col("quality") == 0, F.lit(" true ")).otherwise(F.lit(""))
    c = F.when(F.col("n_chars") < 400, F.lit("True")).otherwise(F.lit("false"))
    arr = F.array(*[F.struct(F.lit(r).alias("rater"), v.alias("raw_flag")) for r, v in zip(RATERS, (a, b, c))])
    return x.select("doc_id", F.inline(arr))


def raw_flag_text(toxic: Column, key: Column) -> Column:
    """Free-text moderation flag in several spellings (NULL when unlabelled)."""
    k = key % 4
    yes = F.when(k == 0, "TRUE").when(k == 1, " true ").when(k == 2, "True").otherwise("1")
    no = F.when(k == 0, "FALSE").when(k == 1, "").when(k == 2, "false ").otherwise("no")
    return F.when(toxic == 1, yes).when(toxic == 0, no)


def echo_prompt(text: Column, label: Column) -> Column:
    return render_replace(TEMPLATE_CLASSIFY, text, label)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses after echo removal (F9 render, reply, F7 strip): doc_id, source, response. What the prompt says of the label is in the
    echo, which is removed again, so no label is joined here and texts stay in the scan: parse them before any join."""
    d = table(spark, sf_dir, "documents")
    prompt = echo_prompt(F.col("text"), F.lit(None).cast("int"))
    raw = F.concat(prompt, reply_for(F.col("doc_id"), F.col("text")))
    return d.select("doc_id", "source", strip_echo(raw, prompt).alias("response"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label, toxic of the labelled items."""
    return table(spark, sf_dir, "labels").select("doc_id", (F.lit(1) - F.col("quality")).alias("label"), "toxic")


def score_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as score replies: run, truth, predicted_score."""
    e = table(spark, sf_dir, "events")
    resp = F.concat(F.lit(SCORE_PREFIX), F.col("value").cast("decimal(12,2)").cast("string"))
    return e.select(
        "event_id",
        F.col("event_type").alias("run"),
        ((F.col("user_id") % 2) == 0).alias("gt_is_ambiguous"),
        parse_score(resp).alias("predicted_score"),
    )


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 1 file: initial rewrite (heading removed, F8), reviewer's is_ok and comment."""
    x = labelled(spark, sf_dir)
    gen = F.concat(F.lit(HEADING_PREFIX), F.col("text"))
    return x.select(
        "doc_id",
        F.col("text").alias("target_sent"),
        "label",
        label_text(F.col("label")).alias("target_label_str"),
        strip_heading(gen).alias("augmented_sent"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(0)).otherwise(F.lit(1)).alias("is_ok"),
        F.concat(F.lit("context: "), F.col("lang")).alias("feedback_comment"),
        F.col("doc_id").alias("_pos"),
    )


def feedback_prompt(a: DataFrame) -> Column:
    """feedback prompt from comment, original, previous text and label."""
    return render_format(
        TEMPLATE_FEEDBACK,
        original=F.col("target_sent"),
        previous=F.col("augmented_sent"),
        label=F.col("target_label_str"),
        comment=F.col("feedback_comment"),
    )


# Fixed values of our own: scenes put before an item's text, one by ``doc_id % 8``, so that the rules for Japanese text have something to find.
SCENES = [
    "信号が赤信号だったため車のブレーキを踏んだ。",
    "友達が朝に学校で話した。",
    "昨日、母親と公園へ行った。",
    "誰が自宅から来たのか。",
    "12月の連休に東京の美術館で働いた。",
    "田中さんは深夜まで会議室にいた。",
    "彼は部屋で休んだ。",
    "",
]
# Fixed values of our own: words of the scenes with the tags that a named-entity model of each of two label sets and a morphological analyser give them.
TAGGED_WORDS = [
    ("朝", "TIME", "TIM", "名詞,普通名詞,副詞可能"),
    ("昨日", "DATE", "DATE", "名詞,普通名詞,副詞可能"),
    ("連休", "EVENT", "MISC", "名詞,普通名詞,一般"),
    ("深夜", "TIME", "TIM", "名詞,時相名詞,*"),
    ("学校", "FACILITY", "FAC", "名詞,普通名詞,一般"),
    ("公園", "FACILITY", "FAC", "名詞,普通名詞,一般"),
    ("東京", "GPE", "LOC", "名詞,固有名詞,地名"),
    ("部屋", "PRODUCT", "MISC", "名詞,普通名詞,一般"),
    ("田中", "PERSON", "PER", "名詞,固有名詞,人名"),
    ("彼", "PERSON", "PSN", "代名詞,*,*"),
    ("誰", "CARDINAL", "MISC", "代名詞,*,*"),
    ("友達", "NORP", "MISC", "名詞,普通名詞,一般"),
    ("母親", "NORP", "MISC", "名詞,普通名詞,一般"),
]


def scene(key: Column) -> Column:
    expr = None
    for i, s in enumerate(SCENES):
        expr = F.when(key % len(SCENES) == i, F.lit(s)) if expr is None else expr.when(key % len(SCENES) == i, F.lit(s))
    return expr


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with a scene before their text: doc_id, text, label."""
    x = items_with_label(spark, sf_dir)
    return x.select("doc_id", F.concat(scene(F.col("doc_id")), F.lit("\n"), F.col("text")).alias("text"), "label")
