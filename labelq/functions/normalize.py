"""Column normalisers: booleans (P7), numeric coercion (P8), label text (P11), names (F20),
partner ids (F19), presence-guarded projections (P1, P2, P5, P6, P18, P20), null-key drops with
observed counts (P10), structure checks and row counts without a second scan (P21, A21)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelq.functions.text import col_of, py_strip

# Label texts of the two classes (0 = acceptable, 1 = not acceptable).
LABEL_TEXT = {0: "許容できる", 1: "許容できない"}
# The exact-map form of the flag normaliser accepts only these spellings.
STRICT_BOOL_MAP = {"True": True, "False": False, "TRUE": True, "FALSE": False}


def to_bool_lenient(c: Column | str) -> Column:
    """``upper(strip(str(x))) == 'TRUE'``; blank, NULL and anything else are False."""
    return F.coalesce(F.upper(py_strip(col_of(c).cast("string"))) == F.lit("TRUE"), F.lit(False))


def to_bool_strict(c: Column | str) -> Column:
    """P7 exact-map form: only the four spellings map; other text stays NULL (null rule 3)."""
    s = col_of(c).cast("string")
    expr = F.when(F.lit(False), F.lit(None).cast("boolean"))
    for text, value in STRICT_BOOL_MAP.items():
        expr = expr.when(s == F.lit(text), F.lit(value))
    return expr


def to_number(c: Column | str, dtype: str = "bigint") -> Column:
    """Numeric coercion, bad values to NULL (``try_cast``; plain cast raises under ANSI)."""
    return col_of(c).cast("string").try_cast(dtype)


def label_text(c: Column | str) -> Column:
    """P11 else-branch form: 0 -> acceptable, anything else (NULL too) -> not acceptable."""
    c = col_of(c)
    return F.when(c == 0, F.lit(LABEL_TEXT[0])).otherwise(F.lit(LABEL_TEXT[1]))


def label_text_strict(c: Column | str) -> Column:
    """P11 strict map form: unmapped codes stay NULL."""
    c = col_of(c)
    return F.when(c == 0, F.lit(LABEL_TEXT[0])).when(c == 1, F.lit(LABEL_TEXT[1]))


def partner_id(c: Column | str) -> Column:
    """partner of an odd id is id + 1, of an even id id - 1."""
    c = col_of(c)
    return F.when(c % 2 != 0, c + 1).otherwise(c - 1)


def safe_name(c: Column | str) -> Column:
    """model id usable as a folder name."""
    return F.replace(col_of(c), F.lit("/"), F.lit("_"))


def base_name(c: Column | str) -> Column:
    """last path segment of a model id."""
    return F.substring_index(col_of(c), "/", -1)


def stem_name(c: Column | str) -> Column:
    """``splitext(basename(path))[0]`` for a prompt path."""
    base = F.substring_index(col_of(c), "/", -1)
    return F.when(
        F.locate(".", F.substr(base, F.lit(2))) > 0,
        F.regexp_extract(base, r"^(.+)\.[^.]*$", 1),
    ).otherwise(base)


def select_present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Select / reorder the wanted columns that exist."""
    return df.select(*[c for c in wanted if c in df.columns])


def drop_present(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop columns if present (absent names are ignored by Spark)."""
    return df.drop(*names)


def add_blank_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Add an empty text column per name, only where missing."""
    missing = {n: F.lit("") for n in names if n not in df.columns}
    return df.withColumns(missing) if missing else df


def any_of_present(df: DataFrame, names: list[str]) -> Column:
    """Logical OR over the named boolean columns that exist (False if none)."""
    present = [F.coalesce(F.col(n), F.lit(False)) for n in names if n in df.columns]
    return reduce(or_, present) if present else F.lit(False)


def columns_matching(df: DataFrame, fragment: str) -> list[str]:
    """P20: columns whose name contains a fragment (rater flag columns)."""
    return [c for c in df.columns if fragment in c]


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Raise ``ValueError`` when a required column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    return df


def alias_first_present(df: DataFrame, target: str, candidates: list[str]) -> DataFrame:
    """Rename the first present candidate column to ``target`` (``sent``, else ``text``)."""
    if target in df.columns:
        return df
    for c in candidates:
        if c in df.columns:
            return df.withColumnRenamed(c, target)
    raise ValueError(f"none of {candidates} present for {target}")


def observe_rows(df: DataFrame, name: str):
    """Row count of a frame, collected by the job that consumes it (no second
    scan). Returns (frame, Observation); read ``obs.get['rows']`` after an action."""
    from pyspark.sql import Observation

    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


def drop_null_keys(df: DataFrame, cols: list[str], name: str = "dropped"):
    """P10: drop rows with a NULL in any of ``cols``; the number dropped is observed in the
    same pass. Returns (kept frame, Observation with ``rows_in`` and ``dropped``)."""
    from pyspark.sql import Observation

    bad = None
    for c in cols:
        cond = F.col(c).isNull()
        bad = cond if bad is None else bad | cond
    obs = Observation(name)
    counted = df.observe(obs, F.count(F.lit(1)).alias("rows_in"), F.count_if(bad).alias("dropped"))
    return counted.where(~bad), obs


def check_rater_columns(df: DataFrame, fragment: str, raters: list[str]) -> list[str]:
    """Flag columns found by name versus raters configured; warns on a mismatch and
    returns the columns found (the run continues, as in the reference)."""
    found = [c for c in df.columns if fragment in c and any(c.split(fragment)[0].rstrip("_") == r for r in raters)]
    if len(found) != len(raters):
        print(f"warning: {len(found)} flag columns found for {len(raters)} configured raters")
    return found
