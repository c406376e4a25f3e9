"""Schemas, keys and the header normaliser."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- fixed values: column names of the budget sheet and the ledger ----------
MANDATORY = ["N_CONTA", "N_CENTRO_CUSTO", "DESCRICAO", "VALOR", "DATA", "VERSAO", "FILIAL"]
OPTIONAL = ["OPERACAO", "TIPO", "RATEIO", "ORIGEM"]
RAW_COLUMNS = [
    "FILIAL", "DATA", "N_CONTA", "N_CENTRO_CUSTO", "OPERACAO", "VALOR",
    "DESCRICAO", "TIPO", "VERSAO", "RATEIO", "ORIGEM",
]
LEDGER_COLUMNS = [
    "N_CONTA", "N_CENTRO_CUSTO", "DESCRICAO", "VALOR", "DATA", "VERSAO",
    "OPERACAO", "DATA_ATUALIZACAO", "FILIAL", "RATEIO", "ORIGEM",
]
AUDIT_COLUMNS = [
    "DATA_IMPORTACAO", "USUARIO", "SISTEMA_OPERACIONAL", "VERSAO_SISTEMA",
    "ARQUIVO_ORIGEM", "TOTAL_REGISTROS", "STATUS", "DETALHES",
]
# merge / edit / delete key
KEYS = ["N_CONTA", "N_CENTRO_CUSTO", "DATA", "VERSAO"]
# columns an edit may set (DATA and VERSAO are never set)
EDITABLE = ["FILIAL", "N_CONTA", "N_CENTRO_CUSTO", "DESCRICAO", "VALOR", "OPERACAO", "RATEIO", "ORIGEM"]
# audit statuses
STATUS_FULL = "IMPORTACAO_COMPLETA"
STATUS_PARTIAL = "ATUALIZACAO_PARCIAL"
STATUS_EDITED = "EDITADO"
STATUS_DELETED = "DELETADO"
# -----------------------------------------------------------------------------

FILE_COL = "ARQUIVO"

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])

LEDGER_SCHEMA = T.StructType([
    T.StructField("N_CONTA", T.StringType(), False),
    T.StructField("N_CENTRO_CUSTO", T.StringType(), False),
    T.StructField("DESCRICAO", T.StringType(), False),
    T.StructField("VALOR", T.DoubleType(), False),
    T.StructField("DATA", T.DateType(), False),
    T.StructField("VERSAO", T.StringType(), False),
    T.StructField("OPERACAO", T.StringType(), True),
    T.StructField("DATA_ATUALIZACAO", T.TimestampNTZType(), False),
    T.StructField("FILIAL", T.StringType(), False),
    T.StructField("RATEIO", T.StringType(), True),
    T.StructField("ORIGEM", T.StringType(), True),
])

# row images of a change: prefixes of a column's value before and after it
IMAGE_BEFORE, IMAGE_AFTER = "ANTES_", "DEPOIS_"
_IMAGED = [f for f in LEDGER_SCHEMA.fields if f.name not in KEYS]
IMAGE_SCHEMA = T.StructType([
    T.StructField("TIPO", T.StringType(), True),
    *[T.StructField(c, LEDGER_SCHEMA[c].dataType, True) for c in KEYS],
    *[T.StructField(p + f.name, f.dataType, True) for p in (IMAGE_BEFORE, IMAGE_AFTER) for f in _IMAGED],
    T.StructField("VEZES", T.LongType(), True),
    T.StructField("SNAPSHOT", T.LongType(), True),
])

AUDIT_SCHEMA = T.StructType([
    T.StructField("DATA_IMPORTACAO", T.TimestampNTZType(), False),
    T.StructField("USUARIO", T.StringType(), False),
    T.StructField("SISTEMA_OPERACIONAL", T.StringType(), False),
    T.StructField("VERSAO_SISTEMA", T.StringType(), False),
    T.StructField("ARQUIVO_ORIGEM", T.StringType(), False),
    T.StructField("TOTAL_REGISTROS", T.LongType(), False),
    T.StructField("STATUS", T.StringType(), False),
    T.StructField("DETALHES", T.StringType(), False),
])


def normalize_header(name: str) -> str:
    """Written header rule: upper case, no accents, ``_`` for spaces."""
    decomposed = unicodedata.normalize("NFKD", name.lstrip("\ufeff").strip().upper())  # drop a byte-order mark
    plain = "".join(ch for ch in decomposed if not unicodedata.combining(ch))
    return "_".join(plain.split())


def normalize_headers(df: DataFrame) -> DataFrame:
    """Rename every column by :func:`normalize_header` (metadata only, no job)."""
    return df.toDF(*[normalize_header(c) for c in df.columns])


def upper_headers(df: DataFrame) -> DataFrame:
    """Header rule as coded: upper case only."""
    return df.toDF(*[c.upper() for c in df.columns])


def missing_mandatory(columns) -> list[str]:
    """G1: mandatory columns absent from a batch, in catalogue order."""
    present = set(columns)
    return [c for c in MANDATORY if c not in present]


def missing_columns_message(columns) -> str | None:
    missing = missing_mandatory(columns)
    if not missing:
        return None
    return "Colunas obrigatórias faltando: " + ", ".join(missing)
