"""Query surface over the ledger.

Filters are folded into one Column predicate starting from ``lit(True)`` (no
SQL text, so no injection); Catalyst folds the constant and pushes the rest to
the parquet scan, where partition filters on VERSAO prune whole directories.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import format as fmt
from ..schema import KEYS, LEDGER_COLUMNS

LISTING_LIMIT = 100  # the listing page shows the 100 most recently updated rows


@dataclass(frozen=True)
class Filters:
    """The nine optional filters of the listing, export and delete forms.

    An empty string (or None) means "not filtered". Dates are ISO ``yyyy-mm-dd``
    text or ``datetime.date``.
    """

    n_conta: str = ""
    n_centro_custo: str = ""
    data_inicio: object = ""
    data_fim: object = ""
    versao: str = ""
    operacao: str = ""
    filial: str = ""
    rateio: str = ""
    origem: str = ""

    def any(self) -> bool:
        return any(getattr(self, f.name) not in ("", None) for f in fields(self))


def _date(v) -> _dt.date:
    return v if isinstance(v, _dt.date) else _dt.date.fromisoformat(str(v))


def predicate(f: Filters) -> Column:
    """Q1: conjunction of the filters that are set (Q1a equality, Q1b range, Q1c LIKE)."""
    p = F.lit(True)
    if f.n_conta:
        p = p & (F.col("N_CONTA").cast("string") == F.lit(f.n_conta))
    if f.n_centro_custo:
        p = p & (F.col("N_CENTRO_CUSTO").cast("string") == F.lit(f.n_centro_custo))
    if f.data_inicio:
        p = p & (F.col("DATA") >= F.lit(_date(f.data_inicio)))
    if f.data_fim:
        p = p & (F.col("DATA") <= F.lit(_date(f.data_fim)))
    if f.versao:
        p = p & (F.col("VERSAO") == F.lit(f.versao))
    if f.operacao:
        p = p & (F.col("OPERACAO") == F.lit(f.operacao))
    if f.filial:
        p = p & (F.col("FILIAL").cast("string") == F.lit(f.filial))
    if f.rateio:
        p = p & (F.col("RATEIO") == F.lit(f.rateio))
    if f.origem:
        # case-sensitive substring; % and _ typed by the user act as wildcards
        p = p & F.col("ORIGEM").like(f"%{f.origem}%")
    return p


def ledger_filter(ledger: DataFrame, f: Filters) -> DataFrame:
    return ledger.where(predicate(f))


def filtered_count(ledger: DataFrame, f: Filters) -> DataFrame:
    """Q2: number of rows matching the filters."""
    return ledger_filter(ledger, f).agg(F.count(F.lit(1)).alias("TOTAL"))


def latest(ledger: DataFrame, f: Filters = Filters(), n: int = LISTING_LIMIT) -> DataFrame:
    """Q3: the n most recently updated rows; ties broken by the key.

    ``orderBy + limit`` plans as TakeOrderedAndProject: each task keeps its own
    top n and only those are merged, so no full sort happens.
    """
    order = [F.col("DATA_ATUALIZACAO").desc()] + [F.col(k).asc() for k in KEYS]
    return ledger_filter(ledger, f).orderBy(*order).limit(n)


def distinct_versions(ledger: DataFrame) -> DataFrame:
    """Q4: every version, newest first."""
    return ledger.select("VERSAO").distinct().orderBy(F.col("VERSAO").desc())


def export_view(ledger: DataFrame, f: Filters = Filters()) -> DataFrame:
    """Q5 + P4: filtered rows, newest first, formatted, with display headings."""
    order = [F.col("DATA_ATUALIZACAO").desc()] + [F.col(k).asc() for k in KEYS]
    rows = ledger_filter(ledger, f).orderBy(*order)
    cols = {
        "N_CONTA": F.col("N_CONTA"),
        "N_CENTRO_CUSTO": F.col("N_CENTRO_CUSTO"),
        "DESCRICAO": F.col("DESCRICAO"),
        "VALOR": fmt.money_grouped("VALOR"),
        "DATA": F.date_format("DATA", fmt.DATE_PATTERN),
        "VERSAO": F.col("VERSAO"),
        "OPERACAO": F.col("OPERACAO"),
        "DATA_ATUALIZACAO": F.date_format("DATA_ATUALIZACAO", fmt.TIMESTAMP_PATTERN),
        "FILIAL": F.col("FILIAL"),
        "RATEIO": F.col("RATEIO"),
        "ORIGEM": F.col("ORIGEM"),
    }
    return rows.select(*[cols[c].alias(fmt.EXPORT_HEADINGS[c]) for c in LEDGER_COLUMNS])


def list_view(ledger: DataFrame) -> DataFrame:
    """P5: the listing page's cells (value with two decimals, 'nan' hidden)."""
    return ledger.select(
        "FILIAL", "N_CONTA", "N_CENTRO_CUSTO", "DESCRICAO",
        fmt.money_plain("VALOR").alias("VALOR"),
        "DATA", "VERSAO",
        fmt.hide_missing("OPERACAO").alias("OPERACAO"),
        fmt.hide_missing("RATEIO").alias("RATEIO"),
        fmt.hide_missing("ORIGEM").alias("ORIGEM"),
        "DATA_ATUALIZACAO",
    )


def column_widths(view: DataFrame) -> DataFrame:
    """Per column, the longest text (or the heading, if longer) plus 2.

    One aggregate pass; the result is unpivoted to (COLUNA, LARGURA).
    """
    cols = view.columns
    wide = view.agg(*[
        F.greatest(F.coalesce(F.max(F.length(F.col(f"`{c}`").cast("string"))), F.lit(0)), F.lit(len(c)))
        .alias(f"_w{i}") for i, c in enumerate(cols)
    ])
    pairs = ", ".join(f"'{c}', _w{i} + 2" for i, c in enumerate(cols))
    return wide.selectExpr(f"stack({len(cols)}, {pairs}) AS (COLUNA, LARGURA)")
