"""Numeric parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_strip


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# what float() reads, without digit grouping; a plain cast also takes type suffixes and hexadecimal
FLOAT = r"(?i)^[+-]?(\d+(\.\d*)?([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)$"


def _number(s: Column) -> Column:
    return F.when(s.rlike(FLOAT), s.try_cast("double"))


def parse_valor(c) -> Column:
    """``float(x)``; null when the text is not a number."""
    return _number(py_strip(_c(c)))


def parse_valor_br(c) -> Column:
    """Dot or comma as decimal separator.

    With a comma present, dots are thousands separators and the comma is the
    decimal point (``1.000,50`` -> 1000.5); a dot behind a comma (``1,000.50``)
    is not a number; otherwise the text parses as is.
    """
    s = py_strip(_c(c))
    br = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return _number(F.when(s.rlike(r",.*\."), None).when(s.contains(","), br).otherwise(s))


def has_at_most_2_decimals(v) -> Column:
    """The value equals itself rounded to cents."""
    v = _c(v)
    return v == F.round(v, 2)
