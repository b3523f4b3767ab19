"""Unicode-aware text helpers as native Column expressions.

Python's ``str.strip``, ``\\s`` and ``\\d`` are Unicode-aware; Spark's ``trim`` removes only
U+0020 and Java's ``\\s`` / ``\\d`` are ASCII. The character sets below are built from the
Unicode database by rule, so the expressions stay inside whole-stage codegen and give the
same answers as the Python code they replace. The patterns use ``\\x{h}`` escapes, which both
Java regex and RE2 (DuckDB) accept, so the SQL oracles can reuse them verbatim.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's str.isspace() defines it.
WHITESPACE_CHARS = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())
WS_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE_CHARS) + "]"

# Decimal digits (category Nd) and their values, as Python's \d and int() read them.
_ND = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
DIGIT_FROM = "".join(_ND)
DIGIT_TO = "".join(str(unicodedata.digit(c)) for c in _ND)

STRIP_PATTERN = f"\\A{WS_CLASS}+|{WS_CLASS}+\\z"


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """``str.strip()``: remove Unicode whitespace at both ends (U+3000 included).

    ``btrim`` with the character set: a scan from each end, no regex."""
    return F.btrim(col_of(c), F.lit(WHITESPACE_CHARS))


def ascii_digits(c: Column | str) -> Column:
    """Map every Unicode decimal digit to its ASCII digit (``'５'`` -> ``'5'``)."""
    return F.translate(col_of(c), DIGIT_FROM, DIGIT_TO)


def sql_str(s: str) -> str:
    """Quote a Python string as an SQL literal (single quotes doubled)."""
    return "'" + s.replace("'", "''") + "'"


def sql_py_strip(expr: str) -> str:
    """DuckDB form of :func:`py_strip`."""
    return f"trim({expr}, {sql_str(WHITESPACE_CHARS)})"


def sql_ascii_digits(expr: str) -> str:
    return f"translate({expr}, {sql_str(DIGIT_FROM)}, {sql_str(DIGIT_TO)})"
