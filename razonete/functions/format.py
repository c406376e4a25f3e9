"""Presentation formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: export headings per ledger column, and display patterns ---
EXPORT_HEADINGS = {
    "N_CONTA": "Conta",
    "N_CENTRO_CUSTO": "Centro de Custo",
    "DESCRICAO": "Descrição",
    "VALOR": "Valor",
    "DATA": "Data",
    "VERSAO": "Versão",
    "OPERACAO": "Operação",
    "DATA_ATUALIZACAO": "Data de Atualização",
    "FILIAL": "Filial",
    "RATEIO": "Rateio",
    "ORIGEM": "Origem",
}
DATE_PATTERN = "dd/MM/yyyy"
TIMESTAMP_PATTERN = "dd/MM/yyyy HH:mm:ss"
CURRENCY_PREFIX = "R$ "
HIDDEN_TEXT = "nan"
# -----------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money_grouped(v) -> Column:
    """``R$ 1,234.50``: thousands grouping, two decimals (half-even)."""
    return F.concat(F.lit(CURRENCY_PREFIX), F.format_number(_c(v), 2))


def money_plain(v) -> Column:
    """``R$ 1234.50``: two decimals, no grouping."""
    return F.concat(F.lit(CURRENCY_PREFIX), F.regexp_replace(F.format_number(_c(v), 2), ",", ""))


def hide_missing(c) -> Column:
    """List view: null, empty or the literal text 'nan' shows as ''."""
    c = _c(c)
    return F.when(c.isNull() | (c == F.lit(HIDDEN_TEXT)), F.lit("")).otherwise(c)
