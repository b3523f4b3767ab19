"""Dense sequential ids (P4) and the neighbour join.

Dense ids without a single-partition step: rows are cut into order-preserving buckets
derived from the sort key itself (not from partition ids, so task retries give the same
answer) on one or more levels, bucket sizes are counted, a prefix sum per level inside the
level above gives each bucket's offset, and ``row_number`` inside each bucket finishes the id.
Equal to a global ``row_number`` over the same order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelq.functions.normalize import partner_id

HEX_BUCKET_DIGITS = 4  # md5 order: 16**4 = 65,536 buckets


def hex_bucket(hex_col: Column | str, digits: int = HEX_BUCKET_DIGITS) -> Column:
    """Order-preserving bucket of a hex digest: its first `digits` hex digits as a number."""
    c = F.col(hex_col) if isinstance(hex_col, str) else hex_col
    return F.conv(F.substring(c, 1, digits), 16, 10).cast("bigint")


def range_bucket(key: Column | str, width: int) -> Column:
    """Order-preserving bucket of a numeric key: floor(key / width)."""
    c = F.col(key) if isinstance(key, str) else key
    whole = c.cast("bigint")
    return ((whole - F.pmod(whole, F.lit(width))).cast("decimal(20,0)") / F.lit(width)).cast("bigint")


def range_levels(key: Column | str, bits: int = 16) -> list[Column]:
    """Levels of a 64-bit whole-number key: its leading ``bits``, twice and three times as many, and so on down to the last ``bits``,
    so no level has more than 2**bits buckets inside a bucket of the level above, however sparse the key."""
    c = (F.col(key) if isinstance(key, str) else key).cast("bigint")
    return [F.shiftright(c, shift) for shift in range(64 - bits, 0, -bits)]


def bucket_offsets(counts: DataFrame, levels: Sequence[str], count: str, offset: str) -> DataFrame:
    """``levels`` and ``offset``: the number of rows in all buckets before, in the lexicographic order of ``levels``.

    ``counts`` has a row per bucket. Each level is summed by the one above it and its prefix sums run inside the
    buckets of that one; only the first level, which the caller bounds, has one window over all of it."""
    table, out = counts, None
    for i in range(len(levels) - 1, -1, -1):
        above = list(levels[:i])
        before = Window.partitionBy(*above).orderBy(levels[i]).rowsBetween(Window.unboundedPreceding, -1)
        here = table.select(*levels[:i + 1], F.coalesce(F.sum(count).over(before), F.lit(0)).alias(f"{offset}{i}"))
        if out is None:
            out = here
        else:
            names = {x: f"{x}_above" for x in levels[:i + 1]}
            up = here.withColumnsRenamed(names)
            same = reduce(and_, [F.col(x).eqNullSafe(F.col(n)) for x, n in names.items()])
            out = out.join(up, same).drop(*names.values())
        if above:
            table = table.groupBy(*above).agg(F.sum(count).alias(count))
    total = sum((F.col(f"{offset}{i}") for i in range(1, len(levels))), F.col(f"{offset}0"))
    return out.select(*levels, total.alias(offset))


def dense_ids(
    df: DataFrame,
    order_cols: Sequence[Column | str],
    bucket: Column | Sequence[Column],
    id_col: str = "ID",
    start: int = 1,
) -> DataFrame:
    """Add ``id_col`` = start .. start + N - 1 in the total order ``order_cols``.

    ``bucket`` is monotone in that order: one column, or levels compared lexicographically (see
    :func:`range_levels`). The first level must be bounded (parts of a union, leading bits or digits); below it no
    step has one partition, whatever the number of buckets. Offsets are joined back null-safe, so rows with a NULL key
    keep their place.
    """
    buckets = [bucket] if isinstance(bucket, Column) else list(bucket)
    bnames = [f"_b{i}" for i in range(len(buckets))]
    x = df.withColumns(dict(zip(bnames, buckets)))
    counts = x.groupBy(*bnames).agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = bucket_offsets(counts, bnames, "_cnt", "_off")
    within = Window.partitionBy(*bnames).orderBy(*order_cols)
    numbered = x.withColumn("_rn", F.row_number().over(within))
    keys = {b: f"{b}_of" for b in bnames}
    same = reduce(and_, [numbered[b].eqNullSafe(F.col(k)) for b, k in keys.items()])
    return (
        numbered.join(offsets.withColumnsRenamed(keys), same)
        .drop(*keys.values())
        .withColumn(id_col, (F.col("_off") + F.col("_rn") + F.lit(start - 1)).cast("bigint"))
        .drop(*bnames, "_rn", "_off")
    )


#: Partner ids that may be broadcast to filter a lookup table (8 bytes each and their hash table).
LOOKUP_IDS = 1 << 20


def pair_lookup(
    targets: DataFrame,
    lookup: DataFrame,
    id_col: str,
    cols: Sequence[str],
    prefix: str = "pair_",
    lookup_id: str | None = None,
    max_ids: int = LOOKUP_IDS,
) -> DataFrame:
    """Every row of ``targets`` with its partner from ``lookup`` (odd id -> id + 1, even id -> id - 1), which need not be a target.

    Adds ``{prefix}id``, ``{prefix}{c}`` for each of ``cols`` of the partner, and ``{prefix}found``; rows without a partner
    stay, with NULLs. While the targets' partner ids are no more than ``max_ids`` (counted first), they are broadcast and filter the
    lookup table where it is scanned, so of its rows only partners are shuffled; beyond that both sides meet in a shuffle join. Repeated
    targets each get the partner. A NULL id has none. An id that ``lookup`` has twice raises, if a target asks for it.
    """
    key = lookup_id or id_col
    asked = targets.withColumn("_partner", partner_id(F.col(id_col).cast("bigint")))
    ids = asked.where(F.col("_partner").isNotNull()).select(F.col("_partner").alias("_wanted")).distinct()
    rows = lookup.select(F.col(key).cast("bigint").alias("_id"), *[F.col(c).alias(f"{prefix}{c}") for c in cols])
    if ids.limit(max_ids + 1).count() <= max_ids:
        rows = rows.join(F.broadcast(ids), F.col("_id") == F.col("_wanted"), "left_semi")
    else:
        rows = rows.where(F.col("_id").isNotNull())
    # One row per id with the size of its group, which is checked where a target asks for it.
    partner = rows.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"), *[F.first(f"{prefix}{c}").alias(f"{prefix}{c}") for c in cols])
    out = asked.join(partner, F.col("_partner") == F.col("_id"), "left")
    out = out.where(F.when(F.coalesce("_n", F.lit(1)) == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"duplicate {key} in pair lookup"))))
    return out.select(*targets.columns, F.col("_partner").alias(f"{prefix}id"), *[f"{prefix}{c}" for c in cols],
                      F.col("_id").isNotNull().alias(f"{prefix}found"))


def _pair_window(df: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """Rows hash-partitioned once by ``pair_no = (id + 1) >> 1`` (integers, exact for any id); each row learns its
    group size and the group's smallest and largest id. ``_ok`` is false for a group that is
    not a valid pair (more than two rows, or two equal ids). Rows without an id are no group."""
    pno = F.shiftright(F.col(id_col).cast("bigint") + 1, 1)
    w = Window.partitionBy("_pno")
    x = df.where(F.col(id_col).isNotNull()).select(F.col(id_col), *[F.col(c) for c in cols]).withColumn("_pno", pno)
    x = x.withColumns(
        {"_n": F.count(F.lit(1)).over(w), "_lo": F.min(id_col).over(w), "_hi": F.max(id_col).over(w)}
    )
    return x.withColumn("_ok", (F.col("_n") == 1) | ((F.col("_n") == 2) & (F.col("_lo") < F.col("_hi"))))


def _checked(condition, id_col: str):
    """The filter condition, or a run-time error on a duplicate id. As part of a filter it stays in
    the plan whatever columns are selected."""
    return F.when(F.col("_ok"), condition).otherwise(F.raise_error(F.lit(f"duplicate {id_col} in pair lookup")))


def pair_join(df: DataFrame, id_col: str, cols: Sequence[str], prefix: str = "pair_") -> DataFrame:
    """Attach the partner row (odd id -> id + 1, even id -> id - 1).

    Both members of a pair share ``pair_no``, so one shuffle on it brings partners together
    and window aggregates hand each row the other's columns: no self-join. Rows without a
    partner are left out (see :func:`pair_missing`). Ids must be unique; a duplicate raises."""
    w = Window.partitionBy("_pno")
    x = _pair_window(df, id_col, cols)
    is_lo = F.col(id_col) == F.col("_lo")
    partner = {
        f"{prefix}{c}": F.when(is_lo, F.max_by(c, id_col).over(w)).otherwise(F.min_by(c, id_col).over(w))
        for c in cols
    }
    pid = F.when(is_lo, F.col("_hi")).otherwise(F.col("_lo"))
    return (
        x.where(_checked(F.col("_n") >= 2, id_col))
        .withColumns(partner)
        .select(F.col(id_col), *[F.col(c) for c in cols], pid.alias(f"{prefix}id"), *partner)
    )


def pair_missing(df: DataFrame, id_col: str) -> DataFrame:
    """J5 report: rows whose partner id is absent (same single shuffle, no join). Rows without an id have none."""
    x = _pair_window(df, id_col, [])
    alone = x.where(_checked(F.col("_n") == 1, id_col)).select(F.col(id_col), partner_id(F.col(id_col)).alias("pair_id"))
    return alone.unionByName(df.where(F.col(id_col).isNull()).select(F.col(id_col), partner_id(F.col(id_col)).alias("pair_id")))
