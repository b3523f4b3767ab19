"""Deterministic shuffles, exact-n samples, stratified samples and splits.

Order is ``md5(key || '-' || seed)``: fixed by the seed, independent of partitioning and
task retries, and computed the same way by other SQL engines (so it is oracle-testable).
The drawn rows cannot equal numpy's; the kept contract is exact n, no replacement,
fixed by seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelq.operators.ids import dense_ids, hex_bucket

SEED = 42


def order_key(key: Column | str, seed: int = SEED) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(f"-{seed}")))


def shuffle_renumber(df: DataFrame, key: str, seed: int = SEED, id_col: str = "ID") -> DataFrame:
    """O2 + P4: full shuffle by seed, then dense ids 1..N in the shuffled order."""
    x = df.withColumn("_h", order_key(key, seed))
    return dense_ids(x, ["_h", key], hex_bucket("_h"), id_col=id_col).drop("_h")


def sample_n(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """O3: exactly min(n, N) rows without replacement. Plans as TakeOrderedAndProject:
    each task keeps its n best rows, no full sort."""
    return df.withColumn("_h", order_key(key, seed)).orderBy("_h", key).limit(n).drop("_h")


def head_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """First n rows by key (never a bare limit)."""
    return df.orderBy(key).limit(n)


def stratified_sample(
    df: DataFrame, key: str, class_col: str, n_per_class: dict, seed: int = SEED
) -> DataFrame:
    """Exactly n rows per class value (all rows of a smaller class).

    The literal bound ``rn <= max(n)`` lets Spark plan a partial WindowGroupLimit before the
    shuffle, so a class holding most rows still sends only a few rows per map task."""
    cap = max(n_per_class.values())
    w = Window.partitionBy(class_col).orderBy("_h", key)
    want = F.lit(0)
    for value, n in n_per_class.items():
        want = F.when(F.col(class_col) == F.lit(value), F.lit(n)).otherwise(want)
    return (
        df.withColumn("_h", order_key(key, seed))
        .withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= F.lit(cap))
        .where(F.col("_rn") <= want)
        .drop("_h", "_rn")
    )


def train_test_split(
    df: DataFrame, key: str, class_col: str, n_per_class: dict, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """O5 + U2: train = stratified sample; test = every row whose key is not in train."""
    train = stratified_sample(df, key, class_col, n_per_class, seed)
    test = df.join(train.select(key), key, "left_anti")
    return train, test


def split_summary(train: DataFrame, test: DataFrame, class_col: str) -> DataFrame:
    """Rows and positives in train, rows in test (one row)."""
    tr = train.agg(F.count(F.lit(1)).alias("train_rows"), F.count_if(F.col(class_col)).alias("train_true"))
    te = test.agg(F.count(F.lit(1)).alias("test_rows"))
    return tr.select("train_rows", "train_true", te.scalar().alias("test_rows"))
