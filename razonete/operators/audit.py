"""Append-only audit rows (A1-A3), built as DataFrames from the data they describe.

Unlike the reference, every mutation is audited and with its true row count.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import AUDIT_COLUMNS, FILE_COL, KEYS, STATUS_DELETED, STATUS_EDITED, STATUS_FULL
from .merge import import_mode
from .query import Filters, predicate

# --- fixed values: audit texts ---------------------------------------------
DETAIL_FULL = "Importação completa"
DETAIL_PARTIAL = "Atualização parcial"
DETAIL_EDIT_PREFIX = "Alterações: "
DETAIL_DELETE_KEY = "Registro deletado manualmente"
DETAIL_DELETE_FILIAL = "Registros deletados para filial "
DETAIL_DELETE_FILTERS = "Registros deletados com filtros: "
ORIGIN_DELETE_FILIAL = "DELETADO: Filial "
ORIGIN_DELETE_FILTERS = "DELETADO: Filtros aplicados"
# delete-by-version is not audited by the reference; these texts are ours
ORIGIN_DELETE_VERSION = "DELETADO: Versão "
DETAIL_DELETE_VERSION = "Registros deletados da versão "
# labels of the filters in the delete-by-filters detail, in the reference's order
FILTER_LABELS = [
    ("Filial", "filial"), ("Conta", "n_conta"), ("Centro Custo", "n_centro_custo"),
    ("Data Início", "data_inicio"), ("Data Fim", "data_fim"), ("Versão", "versao"),
    ("Operação", "operacao"), ("Rateio", "rateio"), ("Origem", "origem"),
]
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class AuditContext:
    """Who/when of a change, passed in by the caller (no host capture, no clock)."""

    as_of: _dt.datetime
    usuario: str = "razonete"
    sistema_operacional: str = ""
    versao_sistema: str = ""


def _audit(df: DataFrame, ctx: AuditContext, origem: Column, total: Column, status: Column, detalhes: Column) -> DataFrame:
    return df.select(
        F.lit(ctx.as_of).cast("timestamp_ntz").alias("DATA_IMPORTACAO"),
        F.lit(ctx.usuario).alias("USUARIO"),
        F.lit(ctx.sistema_operacional).alias("SISTEMA_OPERACIONAL"),
        F.lit(ctx.versao_sistema).alias("VERSAO_SISTEMA"),
        origem.alias("ARQUIVO_ORIGEM"),
        total.cast("long").alias("TOTAL_REGISTROS"),
        status.alias("STATUS"),
        detalhes.alias("DETALHES"),
    ).select(*AUDIT_COLUMNS)


def audit_import(batch: DataFrame, target: DataFrame, ctx: AuditContext, file_col: str = FILE_COL,
                 lot_col: str | None = None) -> DataFrame:
    """A1: one row per (lot, version) of an accepted batch, classified full/partial; the lot is shown by its file name."""
    lot = lot_col or file_col
    per_file = batch.groupBy(F.col(lot).alias("_lot"), "VERSAO").agg(
        F.count(F.lit(1)).alias("_n"), F.first(file_col).alias(file_col))
    modes = import_mode(target, batch).select("VERSAO", "STATUS")
    rows = per_file.join(modes, "VERSAO")
    detail = F.when(F.col("STATUS") == STATUS_FULL, F.lit(DETAIL_FULL)).otherwise(F.lit(DETAIL_PARTIAL))
    return _audit(
        rows, ctx,
        origem=F.concat(F.col("STATUS"), F.lit(": "), F.col(file_col)),
        total=F.col("_n"),
        status=F.col("STATUS"),
        detalhes=F.concat(detail, F.lit(" de "), F.col("_n").cast("string"),
                          F.lit(" registros da versão "), F.col("VERSAO")),
    )


def audit_edit(diff: DataFrame, ctx: AuditContext) -> DataFrame:
    """A2: one row per edit that changed something (``edit_diff`` output)."""
    changed = diff.where(F.col("ALTERACOES") != "")
    return _audit(
        changed, ctx,
        origem=F.concat_ws("/", F.concat(F.lit("EDITADO: "), F.col("NOVO_N_CONTA")), F.col("NOVO_N_CENTRO_CUSTO"),
                           F.col("DATA").cast("string"), F.col("VERSAO")),
        total=F.lit(1),
        status=F.lit(STATUS_EDITED),
        detalhes=F.concat(F.lit(DETAIL_EDIT_PREFIX), F.col("ALTERACOES")),
    )


def audit_delete_keys(ledger: DataFrame, keys: DataFrame, ctx: AuditContext) -> DataFrame:
    """A3 (by key): one row per requested key with the number of rows it removed."""
    from .mutate import typed_keys

    keys = typed_keys(keys)
    asked = keys.select(*KEYS).distinct()
    counts = ledger.join(asked, KEYS, "left_semi").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"))
    rows = keys.select(*KEYS).join(counts, KEYS, "left")
    return _audit(
        rows, ctx,
        origem=F.concat_ws("/", F.concat(F.lit("DELETADO: "), F.col("N_CONTA")), F.col("N_CENTRO_CUSTO"),
                           F.col("DATA").cast("string"), F.col("VERSAO")),
        total=F.coalesce(F.col("_n"), F.lit(0)),
        status=F.lit(STATUS_DELETED),
        detalhes=F.lit(DETAIL_DELETE_KEY),
    )


def _one_row_delete(ledger: DataFrame, cond: Column, ctx: AuditContext, origem: str, detalhes: str) -> DataFrame:
    counted = ledger.agg(F.count_if(F.coalesce(cond, F.lit(False))).alias("_n"))
    return _audit(counted, ctx, F.lit(origem), F.col("_n"), F.lit(STATUS_DELETED), F.lit(detalhes))


def audit_delete_filial(ledger: DataFrame, filial: str, ctx: AuditContext) -> DataFrame:
    return _one_row_delete(ledger, F.col("FILIAL") == F.lit(filial), ctx,
                           ORIGIN_DELETE_FILIAL + filial, DETAIL_DELETE_FILIAL + filial)


def audit_delete_version(ledger: DataFrame, versao: str, ctx: AuditContext) -> DataFrame:
    return _one_row_delete(ledger, F.col("VERSAO") == F.lit(versao), ctx,
                           ORIGIN_DELETE_VERSION + versao, DETAIL_DELETE_VERSION + versao)


def filters_text(f: Filters) -> str:
    return ", ".join(f"{label}={getattr(f, attr) or ''}" for label, attr in FILTER_LABELS)


def audit_delete_filtered(ledger: DataFrame, f: Filters, ctx: AuditContext) -> DataFrame:
    return _one_row_delete(ledger, predicate(f), ctx, ORIGIN_DELETE_FILTERS, DETAIL_DELETE_FILTERS + filters_text(f))
