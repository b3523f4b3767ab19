"""Corpus preparation over ``documents`` in five stages, each one operator of ``labelq.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.  ``run`` writes each stage's
result to the shared folder and reads it back as the next one's input.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelq.llm import mixing, ngram_jaccard, quality_knn, sentencepiece_bpe, suffix_dedup
from labelq.llm.common import materialize, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents with a lower quality score go.
MIN_QUALITY = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose voted quality is MIN_QUALITY or more.  Null and empty texts get the labelled sample's mean label; rows with a null doc_id
    and repeated rows are judged by their text like others; extra columns go."""
    labels = read(spark, sf_dir, "labels").where(~quality_knn.held_out(F.col("doc_id"), 4, 2)).select("doc_id", "quality")
    model = quality_knn.fit(docs, labels)
    return quality_knn.score(docs, model, COLUMNS).where(F.col("score") >= MIN_QUALITY).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group linked by five-word shingles at 0.8 or more.  Rows that are equal in all
    columns stay once.  Rows of different content that share the smallest doc_id all stay, as do rows with a null doc_id,
    which are in no group, and texts without words, which link with nothing."""
    groups = ngram_jaccard.ngram_components(docs, 5, 80)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    rows = docs.select(*COLUMNS).dropDuplicates()
    named = rows.join(kept, "doc_id", "left_semi").select(*COLUMNS)
    return named.unionByName(docs.select(*COLUMNS).where(F.col("doc_id").isNull()).dropDuplicates())


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 or more bytes that an earlier document holds; documents left blank (null, empty or white space)
    go.  Rows with a null doc_id stay whole, rows of one doc_id do not cut each other."""
    out = suffix_dedup.remove_repeats(docs.select(*COLUMNS), keep_text=True)
    out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.where(F.length(F.btrim("text", F.lit(" \t\n\u000b\f\r"))) > 0).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it (0, 1 or 2 times); texts without words once.  Rows are told apart by
    doc_id and text, nulls included; rows equal in both share their copies."""
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_k"))
    plan = mixing.mix_plan(keyed, keys=["_k"]).groupBy("_k").agg(F.sum("copies").alias("_sum"), F.count("*").alias("_rows"))
    at = F.row_number().over(Window.partitionBy("_k").orderBy(*COLUMNS))
    rows = keyed.join(plan.where("_sum > 0"), "_k").withColumn("_at", at)
    copies = F.expr("CAST(_sum DIV _rows + IF(_at <= _sum % _rows, 1, 0) AS INT)")
    rows = rows.withColumn("_copies", copies).where("_copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of the mix, copies and rows with a null doc_id included."""
    import public_tokenizers

    return sentencepiece_bpe.encode_column(docs, sentencepiece_bpe.load_model(public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_passages),
          ("mixing sources to target weights", mix), ("SentencePiece encoding and decoding", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline")
    return docs
