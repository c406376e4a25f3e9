"""Date parsing (N7, N8). ``try_to_date`` never raises under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: accepted day-first pattern, and the four patterns of the
# flexible parser in the order they are tried --------------------------------
DAY_FIRST = "d/M/yyyy"
FLEXIBLE = ["yyyy-M-d", "d/M/yyyy", "yyyy/M/d", "d-M-yyyy"]
# -----------------------------------------------------------------------------

CANONICAL = "dd/MM/yyyy"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c, formats=(DAY_FIRST,)) -> Column:
    """First pattern that parses wins; null when none does."""
    s = F.trim(_c(c))
    parsed = [F.try_to_date(s, fmt) for fmt in formats]
    return parsed[0] if len(parsed) == 1 else F.coalesce(*parsed)


def parse_date_flex(c) -> Column:
    """The four patterns of the edit/delete forms, in order."""
    return parse_date(c, FLEXIBLE)


def canonical_date(d) -> Column:
    """Presentation of a DateType column as dd/MM/yyyy."""
    return F.date_format(_c(d), CANONICAL)
