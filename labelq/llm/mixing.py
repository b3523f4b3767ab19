"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Each source gets a target number of words.  Document rates solve, per source, the entropy
problem ``min sum r log r - r`` subject to ``sum r_d size_d = target`` and ``r_d <= cap``.  Its
solution is an exponential tilt ``r_d = min(cap, exp(lambda_s x_d))`` with ``x_d`` the size over
the source's mean size.  The dual is convex in one multiplier per source; distributed,
bracketed Newton steps solve all sources at once.  The dual depends on documents only through
(source, size), so the steps run on that histogram, not on the documents.

Rates become whole copies by systematic rounding along each source's sizes: the running sum of
expected copies is rounded, so the words taken miss the target by about one document.  Inside a
(source, size) class the documents that get the extra copy are chosen by a hash of doc_id;
classes are split over ``SALTS`` hash buckets before ranking, so a class with a third of all
rows is ranked in many tasks.

Defined results: null text and blank text have size 0 and take 0 words; a null source is a
source of its own, ordered last; repeated rows are separate documents; null doc_id is allowed;
an empty table gives an empty result; extra columns are ignored by ``mix_plan``.  All sums that
steer a decision are exact decimals, so reruns agree whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelq.llm.common import materialize, read, words

#: Hash buckets per (source, size) class for ranking.
SALTS = 64
#: Newton steps stop when every source is within this share of its target, or after MAX_STEPS.
TOLERANCE = 1e-5
MAX_STEPS = 40


def _source_key(source: Column) -> Column:
    """A key that is never null and sorts by code point with the null source last ('=' < '>')."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(">"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5,
                   cap: float = 2.0) -> DataFrame:
    """One row per source: ``_src, source_size, mean_size, target``.

    ``sizes`` has one row per (``_src``, ``size``) with ``n`` documents.  The k-th source by code point
    (null last) weighs ``weights[k mod len]``; ``share`` times all sizes are dealt by weight; a target
    stops at ``cap`` times its source and the excess goes to the others by weight.  The windows
    run over one row per source, the length of a mixture specification."""
    per = sizes.groupBy("_src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("_docs"))
    order = Window.orderBy("_src")
    k = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (k + 1).cast("int"))
    per = per.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(cap))
    # Water level: sources with the smallest cap per weight fill first; the level after the first
    # j of them are full is (total - their caps) / (weights of the rest).
    fill = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), "_src")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(share)
    per = per.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest))
    per = per.withColumn("_full", F.col("_level") * F.col("_w") >= F.col("_cap"))
    # Full sources form a prefix of the fill order; after it the computed level only falls, so the
    # largest level of a source that is not full holds for all of them.
    level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(everything)
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(level * F.col("_w"), F.col("_cap")))
    return per.select("_src", "source_size", (F.col("source_size") / F.col("_docs")).alias("mean_size"),
                      F.coalesce(target, F.lit(0.0)).alias("target"))


def _rate(lam: Column, size: Column, mean: Column, cap: float) -> Column:
    # exp is bounded before it is taken: log(cap) at most, -60 at least.
    return F.exp(F.greatest(F.lit(-60.0), F.least(F.log(F.lit(cap)), lam * size / mean)))


def solve_rates(sizes: DataFrame, targets: DataFrame, cap: float = 2.0, max_steps: int = MAX_STEPS,
                tolerance: float = TOLERANCE) -> DataFrame:
    """``sizes`` with the rate of each (source, size) class that meets the source's target.

    Bracketed Newton on ``log(taken(lambda)) = log(target)``; every step is one grouped sum
    over the histogram.  Targets at ``cap`` times their source need no multiplier."""
    hist = materialize(
        sizes.where("size > 0").join(targets, "_src").select("_src", "size", "n", "mean_size", "target"), "mix-hist")
    big = 1e6
    state = targets.select("_src", "target", F.lit(0.0).alias("lam"), F.lit(-big).alias("lo"), F.lit(big).alias("hi"),
                           (F.col("target") >= F.col("source_size") * F.lit(cap) * (1 - 1e-12)).alias("full"))
    state = materialize(state, "mix-dual")
    for _ in range(max_steps):
        x, lam = F.col("size") / F.col("mean_size"), F.col("lam")
        r = _rate(lam, F.col("size"), F.col("mean_size"), cap)
        taken = (F.col("n") * F.col("size") * r).cast("decimal(38,9)")
        slope = F.when(lam * x < F.log(F.lit(cap)), F.col("n") * F.col("size") * r * x).otherwise(0.0).cast("decimal(38,9)")
        sums = (hist.join(state.where(~F.col("full")).select("_src", "lam"), "_src").groupBy("_src")
                .agg(F.sum(taken).cast("double").alias("_got"), F.sum(slope).cast("double").alias("_slope"),
                     F.max("target").alias("_target")))
        err = F.log(F.col("_got") / F.col("_target"))
        step = state.join(sums, "_src", "left")
        step = step.withColumn("_err", F.when(F.col("_got") > 0, err).when(F.col("_got") == 0, F.lit(-1.0)))
        step = step.withColumn("hi", F.when(F.col("_err") > 0, F.least("hi", "lam")).otherwise(F.col("hi")))
        step = step.withColumn("lo", F.when(F.col("_err") < 0, F.greatest("lo", "lam")).otherwise(F.col("lo")))
        newton = F.col("lam") - F.col("_err") * F.col("_got") / F.col("_slope")
        middle = F.when(F.col("lo") <= -big, F.col("hi") * 2 - 1).when(F.col("hi") >= big, F.col("lo") * 2 + 1) \
            .otherwise((F.col("lo") + F.col("hi")) / 2)
        inside = (F.col("_slope") > 0) & (newton > F.col("lo")) & (newton < F.col("hi"))
        done = F.col("_err").isNull() | (F.abs("_err") <= tolerance)
        moved = F.when(done, F.col("lam")).when(inside, newton).otherwise(middle)
        state = materialize(step.select("_src", "target", F.round(moved, 12).alias("lam"), "lo", "hi", "full",
                                        (~done).alias("open")), "mix-dual")
        if not state.where("open").head(1):
            break
        state = state.drop("open")
    joined = hist.join(state.select("_src", "lam", "full"), "_src")
    rate = F.when(F.col("full"), F.lit(cap)).otherwise(_rate(F.col("lam"), F.col("size"), F.col("mean_size"), cap))
    return joined.select("_src", "size", "n", F.round(rate, 9).alias("rate"))


def mix_plan(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0,
             keys: Sequence[str] = ()) -> DataFrame:
    """``doc_id, size, source_size, target, copies, rate`` of each row of ``docs`` (doc_id, text, source), and its ``keys``."""
    rows = materialize(docs.select("doc_id", *keys, _source_key(F.col("source")).alias("_src"), F.size(words(F.col("text"))).cast("long").alias("size")),
                       "mix-sizes")
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    salted = materialize(rows.groupBy("_src", "size", "_salt").agg(F.count("*").alias("n")), "mix-salted")
    sizes = salted.groupBy("_src", "size").agg(F.sum("n").alias("n"))
    targets = materialize(source_targets(sizes, weights, share, cap), "mix-targets")
    rates = solve_rates(sizes, targets, cap)
    # Copies of a class: the running expectation along sizes, rounded at both of its ends.
    along = Window.partitionBy("_src").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    expected = (F.col("n") * F.col("rate")).cast("decimal(38,9)")
    ends = rates.withColumn("_end", F.sum(expected).over(along)).withColumn("_begin", F.col("_end") - expected)
    quota = ends.select("_src", "size", "n", "rate", (F.floor(F.col("_end") + F.lit(0.5)) - F.floor(F.col("_begin") + F.lit(0.5))).alias("_copies"))
    quota = quota.select("_src", "size", "rate", F.expr("_copies div n").alias("_each"), F.expr("_copies % n").alias("_extra"))
    # Extra copies go to the first rows of a class by (bucket, hash): earlier buckets are counted, rows ranked per bucket.
    by_salt = Window.partitionBy("_src", "size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    earlier = salted.withColumn("_before", F.coalesce(F.sum("n").over(by_salt), F.lit(0)))
    quota = earlier.join(quota, ["_src", "size"]).select("_src", "size", "_salt", "_before", "rate", "_each", "_extra")
    rank = F.row_number().over(Window.partitionBy("_src", "size", "_salt").orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id", *keys))
    out = rows.withColumn("_rank", rank).join(quota, ["_src", "size", "_salt"], "left")
    extra = F.when(F.col("_before") + F.col("_rank") <= F.col("_extra"), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.col("_each") + extra).otherwise(1).cast("long")
    out = out.select("doc_id", *keys, "size", "_src", copies.alias("copies"), F.coalesce("rate", F.lit(1.0)).alias("rate"))
    return out.join(targets.select("_src", "source_size", "target"), "_src") \
        .select("doc_id", *keys, "size", "source_size", "target", "copies", "rate")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken (= copies times size) of every document."""
    plan = mix_plan(read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


QUERIES = {"op6_mixing": op6_mixing}
