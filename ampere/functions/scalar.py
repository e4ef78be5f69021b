"""Column-level helpers (no jobs, all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number shape accepted by the lenient string -> double cast.
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
# Bracket characters removed from timestamp cells, e.g. "[31/10/2021 23:00]".
BRACKETS_PATTERN = r"[\[\]]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_brackets(c: str | Column) -> Column:
    """remove every '[' and ']'."""
    return F.regexp_replace(col(c), BRACKETS_PATTERN, "")


def first_comma_to_dot(c: str | Column) -> Column:
    """European decimal comma; only the first comma is replaced."""
    return F.regexp_replace(col(c), r"^([^,]*),", "$1.")


def lenient_double(c: str | Column) -> Column:
    """F2 + F5: string -> double; anything that is not a plain number -> null."""
    s = first_comma_to_dot(c)
    return F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))


def parse_timestamp(c: str | Column, fmt: str = "d/M/yyyy H:mm", fallback: bool = False) -> Column:
    """F1 + F3 (+ F4): bracketed day-first stamp -> timestamp_ntz; failures -> null.

    ``fallback=True`` also tries Spark's default timestamp formats when the
    given pattern does not match.
    """
    s = strip_brackets(c)
    parsed = F.try_to_timestamp(s, F.lit(fmt))
    if fallback:
        parsed = F.coalesce(parsed, F.try_to_timestamp(s))
    return parsed.cast("timestamp_ntz")


def safe_div(a: Column, b: Column) -> Column:
    """division that yields null for a zero or null divisor."""
    return F.try_divide(a, b)


def contains_ci(c: str | Column, word: str) -> Column:
    """case-insensitive substring test, null -> false."""
    return F.coalesce(F.lower(col(c)).contains(word.lower()), F.lit(False))


def title_label(name: str) -> str:
    """axis label from a snake_case column name (metadata only)."""
    return name.replace("_", " ").title()


def py_float_text(x: float) -> str:
    """Python's text form of a float literal, e.g. 10 -> '10.0'."""
    return repr(float(x))


def py_round(c: str | Column, digits: int) -> Column:
    """Python's ``round(x, digits)`` on doubles -- half to even on
    the exact binary value (so 2.675 -> 2.67), unlike SQL ROUND."""
    x = col(c)
    pattern = "0." + "0" * digits if digits > 0 else "0"
    text = F.call_function("format_number", x, F.lit(pattern))
    special = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(special, x).otherwise(text.try_cast("double"))
