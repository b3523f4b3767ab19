"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelq.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) of every node of ``edges`` (a, b: long, a <> b).

    Each round points every node's larger neighbours, then its smaller ones, to the smallest node it
    knows; star forests come out after a number of rounds logarithmic in the number of nodes.  A round is
    a partial aggregate and a join on the node, which Spark can split at hub nodes; its result is
    written to the shared folder, so nothing is gathered on the driver but a flag."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = materialize(e, "cc")
    while True:
        # Large star: (u, v) seen from both ends; larger neighbours go to the smallest of the neighbourhood.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = materialize(large, "cc")
        discard(e)
        # Small star: every node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v") \
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        small = materialize(small, "cc")
        discard(large)
        # Done when every node has one parent and no parent has one itself.
        open_ = small.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").head(1) \
            or small.join(small.select(F.col("u").alias("v")).distinct(), "v", "left_semi").head(1)
        e = small
        if not open_:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
