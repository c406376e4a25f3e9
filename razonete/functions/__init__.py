"""Column-level building blocks: normalisers, parsers and display formats."""

from .dates import canonical_date, parse_date, parse_date_flex
from .format import hide_missing, money_grouped, money_plain
from .numbers import parse_valor, parse_valor_br
from .text import (
    clean_text,
    default_tipo,
    digits_only,
    is_blank,
    normalize_rateio,
    py_strip,
    squash,
    squash_upper,
    zfill_branch,
)

__all__ = [
    "canonical_date", "parse_date", "parse_date_flex", "hide_missing", "money_grouped",
    "money_plain", "parse_valor", "parse_valor_br", "clean_text", "default_tipo",
    "digits_only", "is_blank", "normalize_rateio", "py_strip", "squash", "squash_upper",
    "zfill_branch",
]
