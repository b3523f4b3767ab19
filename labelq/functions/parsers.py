"""Response parsers F1-F8 as native Column expressions (they stay in codegen).

Each parser reads a model response column and returns a typed Column. Null responses
never raise: they fall into the "no match" branch of each parser.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelq.functions.text import WS_CLASS, ascii_digits, col_of, py_strip

# Fixed values used by the reference's parsers.
PHRASE_NOT_ACCEPTABLE = "許容できない"  # F1, tested first
PHRASE_ACCEPTABLE = "許容できる"  # F1, tested second
STEPWISE_MARKER = "最終判定"  # the verdict follows the last occurrence
OUTPUT_HEADING = "シナリオA:"  # F8: heading removed from rewrites
NOT_AVAILABLE = "N/A"  # text stored for a NO decision

# a YES / NO line, then the next non-blank line. Python flags re.M | re.I, with
# Python's Unicode \s; (?d) makes only \n a line terminator, as in Python.
_YES_NO_BODY = f"^(YES|NO){WS_CLASS}*\\n{WS_CLASS}*(.*)$"
YES_NO_PATTERN = "(?imdu)" + _YES_NO_BODY
# The same pattern for RE2 (the DuckDB oracle): its `.` and `$` already treat only \n as a
# line break, and its case folding is Unicode-aware.
YES_NO_PATTERN_RE2 = "(?im)" + _YES_NO_BODY


def parse_label(response: Column | str) -> Column:
    """1 if the negative phrase occurs, else 0 if the positive one does, else -1."""
    r = py_strip(response)
    return (
        F.when(r.contains(PHRASE_NOT_ACCEPTABLE), F.lit(1))
        .when(r.contains(PHRASE_ACCEPTABLE), F.lit(0))
        .otherwise(F.lit(-1))
    )


def parse_verdict(response: Column | str) -> Column:
    """``TRUE`` anywhere, any case."""
    return F.coalesce(F.upper(col_of(response)).contains("TRUE"), F.lit(False))


def parse_bracket(response: Column | str) -> Column:
    """bracketed ``[TRUE]`` only, any case."""
    return F.coalesce(F.upper(col_of(response)).contains("[TRUE]"), F.lit(False))


def parse_stepwise(response: Column | str) -> Column:
    """verdict after the last marker (TRUE, then FALSE); else F2 on the whole reply."""
    r = col_of(response)
    tail = F.upper(F.substring_index(r, STEPWISE_MARKER, -1))
    has_marker = F.coalesce(r.contains(STEPWISE_MARKER), F.lit(False))
    return (
        F.when(has_marker & tail.contains("TRUE"), F.lit(True))
        .when(has_marker & tail.contains("FALSE"), F.lit(False))
        .otherwise(parse_verdict(r))
    )


def parse_score(response: Column | str, lo: int = 0, hi: int = 10) -> Column:
    """first run of decimal digits (Unicode digits too), clamped to [lo, hi]; else NULL.

    A run that does not fit 38 digits is above any ``hi`` and clamps to it.
    """
    # \p{Nd} is the Unicode decimal-digit category, Python's \d; only the first run is
    # translated to ASCII, not the whole text
    digits = ascii_digits(F.regexp_extract(col_of(response), r"(\p{Nd}+)", 1))
    significant = F.ltrim(digits, F.lit("0"))
    value = F.when(significant == "", F.lit(0)).otherwise(significant.try_cast("decimal(38,0)"))
    clamped = F.least(F.greatest(value, F.lit(lo)), F.lit(hi))
    return (
        F.when(F.coalesce(digits, F.lit("")) == "", F.lit(None).cast("int"))
        .when(value.isNull(), F.lit(hi))
        .otherwise(clamped.cast("int"))
    )


def parse_yes_no(response: Column | str) -> Column:
    """struct(decision, text). NO forces N/A; no match means (NO, N/A)."""
    r = py_strip(response)
    word = F.upper(F.regexp_extract(r, YES_NO_PATTERN, 1))
    text = py_strip(F.regexp_extract(r, YES_NO_PATTERN, 2))
    matched = F.coalesce(word != "", F.lit(False))
    decision = F.when(matched, word).otherwise(F.lit("NO"))
    body = F.when(matched & (word == "YES"), text).otherwise(F.lit(NOT_AVAILABLE))
    return F.struct(decision.alias("decision"), body.alias("text"))


def strip_echo(response: Column | str, prompt: Column | str) -> Column:
    """remove the echoed prompt (literal replace), then strip Unicode whitespace."""
    return py_strip(F.replace(col_of(response), col_of(prompt), F.lit("")))


def strip_heading(text: Column | str, heading: str = OUTPUT_HEADING) -> Column:
    """F8: remove the output heading and strip again."""
    return py_strip(F.replace(py_strip(text), F.lit(heading), F.lit("")))
