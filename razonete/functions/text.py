"""Scalar text normalisers (N1-N6) as ``Column -> Column`` expressions.

All are built-in Catalyst expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: accented capitals that lose their accent, and their plain
# letters, in the order the reference lists them (other letters keep theirs) --
ACCENTED = "ÁÀÂÃÉÈÊÍÌÎÓÒÔÕÚÙÛÇ"
PLAIN = "AAAAEEEIIIOOOOUUUC"
# ------------------------------------------------------------------------------

# Python's str.split() splits on Unicode white space plus the four ASCII
# separator controls \x1c-\x1f; (?U) makes Java's \s Unicode-aware.
WS_RUN = r"(?U)[\s\x{1C}-\x{1F}]+"
EDGE_WS = r"(?U)^[\s\x{1C}-\x{1F}]+|[\s\x{1C}-\x{1F}]+$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squash(c) -> Column:
    """Collapse every run of white space to one space and trim both ends."""
    return F.trim(F.regexp_replace(_c(c), WS_RUN, " "))


def py_strip(c) -> Column:
    """Remove leading and trailing (Unicode) white space, like ``str.strip()``."""
    return F.regexp_replace(_c(c), EDGE_WS, "")


def clean_text(c) -> Column:
    """Upper case, strip the listed accents, collapse white space. Null passes."""
    return squash(F.translate(F.upper(_c(c)), ACCENTED, PLAIN))


def squash_upper(c) -> Column:
    """Collapse white space and upper-case; accents are kept."""
    return F.upper(squash(c))


def zfill_branch(c) -> Column:
    """Strip; an all-digit value shorter than 4 is left-padded with zeros.

    ``lpad`` would truncate longer input, hence the length guard.
    """
    s = py_strip(c)
    return F.when(s.rlike(r"^[0-9]+$") & (F.length(s) < 4), F.lpad(s, 4, "0")).otherwise(s)


def digits_only(c) -> Column:
    """Keep decimal digits only."""
    return F.regexp_replace(_c(c), r"[^0-9]", "")


def is_blank(c) -> Column:
    """Null or the empty string (the reference's ``isna(x) or x == ''``)."""
    c = _c(c)
    return c.isNull() | (c == F.lit(""))


def default_tipo(c) -> Column:
    """N5 + V9: null/empty -> 'ORCADO'; otherwise collapse and upper-case."""
    return F.when(is_blank(c), F.lit("ORCADO")).otherwise(squash_upper(c))


def normalize_rateio(c) -> Column:
    """Collapse + upper, then 'NÃO' -> 'NAO'; null/empty -> ''."""
    s = squash_upper(c)
    return F.when(is_blank(c), F.lit("")).when(s == F.lit("NÃO"), F.lit("NAO")).otherwise(s)
