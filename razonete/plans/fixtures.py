"""Deterministic ledger fixtures derived from the test tables.

Each fixture is one SQL text that Spark and DuckDB both run unchanged, so the
oracle side reads exactly the same input rows. On Spark the text is executed
with the source DataFrame bound as a parameter (``spark.sql(text, t=df)``), so
Catalyst prunes the scan to the columns used and no global view is created.
Faults are injected by key arithmetic; every lineitem row yields one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Raw, untyped budget lines with injected faults (one per lineitem row).
RAW_SQL = """
SELECT
  CASE WHEN l_suppkey % 41 = 0 THEN 'Filial X' WHEN l_suppkey % 43 = 0 THEN CAST(NULL AS STRING)
       ELSE CAST(100 + l_suppkey % 20 AS STRING) END AS FILIAL,
  CASE WHEN l_partkey % 101 = 0 THEN 'data invalida'
       ELSE lpad(CAST(day(l_shipdate) AS STRING), 2, '0') || '/' || lpad(CAST(month(l_shipdate) AS STRING), 2, '0')
            || '/' || CAST(year(l_shipdate) AS STRING) END AS DATA,
  CASE WHEN l_partkey % 103 = 0 THEN '1234' WHEN l_partkey % 107 = 0 THEN CAST(NULL AS STRING)
       ELSE CAST(10000000 + (l_partkey * 7919) % 80000000 AS STRING) END AS N_CONTA,
  CASE WHEN l_orderkey % 47 = 0 THEN CAST(NULL AS STRING) WHEN l_orderkey % 109 = 0 THEN '12345'
       ELSE CAST(100000000 + l_orderkey AS STRING) END AS N_CENTRO_CUSTO,
  CASE WHEN l_partkey % 113 = 0 THEN 'OPERACAO MUITO GRANDE' WHEN l_linenumber = 3 THEN CAST(NULL AS STRING)
       ELSE ' op  ' || CAST(l_linenumber AS STRING) || ' ' END AS OPERACAO,
  CASE WHEN l_orderkey % 127 = 0 THEN 'abc' WHEN l_orderkey % 131 = 0 THEN CAST(NULL AS STRING)
       ELSE CAST(l_extendedprice AS STRING) END AS VALOR,
  CASE WHEN l_orderkey % 137 = 0 THEN CAST(NULL AS STRING)
       ELSE '  Manutenção   predial ' || l_returnflag END AS DESCRICAO,
  CASE WHEN l_linestatus = 'F' THEN CAST(NULL AS STRING) ELSE 'normal' END AS TIPO,
  CASE WHEN l_partkey % 139 = 0 THEN 'Versao Invalida'
       ELSE CAST(year(l_shipdate) AS STRING) || ' - v' || CAST(1 + l_linenumber % 3 AS STRING) END AS VERSAO,
  CASE WHEN l_suppkey % 37 = 0 THEN 'TALVEZ' WHEN l_linenumber % 4 = 0 THEN 'não'
       WHEN l_linenumber % 4 = 1 THEN 'sim' WHEN l_linenumber % 4 = 2 THEN 'NAO' ELSE CAST(NULL AS STRING) END AS RATEIO,
  CASE WHEN l_partkey % 149 = 0 THEN 'ESTA É UMA ORIGEM MUITO LONGA QUE EXCEDE OS 60 CARACTERES PERMITIDOS PELO SISTEMA'
       WHEN l_linenumber = 5 THEN CAST(NULL AS STRING)
       ELSE 'Sístema   Fínanceíro ' || l_linestatus END AS ORIGEM,
  {lot} AS ARQUIVO
FROM {lineitem}
"""

# lot per supplier bucket (ten lots, all faulty) / per order (~4 rows a lot)
LOT_BY_SUPPLIER = "'lote_' || CAST(l_suppkey % 10 AS STRING) || '.csv'"
LOT_BY_ORDER = "'lote_' || CAST(l_orderkey AS STRING) || '.csv'"

# sixty larger lots: files of good lines, files of lines with faults, files whose cost centres do not pass
LOT_BY_KIND = """CASE WHEN l_suppkey % 41 = 0 OR l_suppkey % 43 = 0 OR l_suppkey % 37 = 0 OR l_partkey % 101 = 0 OR l_partkey % 113 = 0
       OR l_partkey % 149 = 0 OR l_orderkey % 127 = 0 OR l_orderkey % 137 = 0 THEN 'falhas_'
       WHEN l_orderkey % 47 = 0 OR l_orderkey % 109 = 0 THEN 'centro_' ELSE 'lote_' END || CAST(l_orderkey % 20 AS STRING) || '.csv'"""

_LEDGER_SQL = """
SELECT CAST(10000000 + (l_partkey * 7919) % 80000000 AS STRING) AS N_CONTA,
  CAST(100000000 + l_orderkey AS STRING) AS N_CENTRO_CUSTO,
  {descricao} || l_returnflag AS DESCRICAO,
  {valor} AS VALOR,
  CAST(l_shipdate AS DATE) AS DATA,
  CAST(year(l_shipdate) AS STRING) || ' - V' || {versao} AS VERSAO,
  'OP' || CAST(l_linenumber AS STRING) AS OPERACAO,
  {atualizacao} AS DATA_ATUALIZACAO,
  lpad(CAST(100 + l_suppkey % 20 AS STRING), 4, '0') AS FILIAL,
  CASE WHEN l_linenumber % 3 = 0 THEN 'SIM' WHEN l_linenumber % 3 = 1 THEN 'NAO' ELSE CAST(NULL AS STRING) END AS RATEIO,
  CASE WHEN l_linenumber = 5 THEN CAST(NULL AS STRING) ELSE 'SISTEMA ' || l_linestatus END AS ORIGEM
FROM {lineitem}
"""

LED_SQL = _LEDGER_SQL.format(
    descricao="'LINHA '", valor="l_extendedprice", atualizacao="l_shipdate",
    versao="CAST(1 + l_linenumber % 3 AS STRING)", lineitem="{lineitem}",
)
DELTA_SQL = _LEDGER_SQL.format(
    descricao="'REVISTA '", valor="l_extendedprice + 1",
    atualizacao="l_shipdate + INTERVAL '1' DAY",
    # a third of the lines gets a new key, in versions that the ledger does not have yet
    versao="CASE WHEN l_linenumber % 3 = 2 THEN '4' ELSE CAST(1 + l_linenumber % 3 AS STRING) END", lineitem="{lineitem}",
)

# A batch with repeated merge keys: a second, later copy of some delta rows.
DELTA_DUP_SQL = """
SELECT * FROM {delta}
UNION ALL
SELECT N_CONTA, N_CENTRO_CUSTO, DESCRICAO, VALOR * 2 AS VALOR, DATA, VERSAO, OPERACAO,
       DATA_ATUALIZACAO + INTERVAL '1' DAY AS DATA_ATUALIZACAO, FILIAL, RATEIO, ORIGEM
FROM {delta} WHERE FILIAL < '0105'
"""

# Requested edits: key of the record + the eight settable values.
EDITS_SQL = """
SELECT N_CONTA, N_CENTRO_CUSTO, DATA, VERSAO,
  '0199' AS NOVO_FILIAL, N_CONTA AS NOVO_N_CONTA, N_CENTRO_CUSTO AS NOVO_N_CENTRO_CUSTO,
  DESCRICAO AS NOVO_DESCRICAO, VALOR + 10 AS NOVO_VALOR, OPERACAO AS NOVO_OPERACAO,
  'SIM' AS NOVO_RATEIO, ORIGEM AS NOVO_ORIGEM
FROM {led}
WHERE CAST(N_CENTRO_CUSTO AS BIGINT) % 50 = 1
"""


# Raw lines as CSV text, in the order of their lot's file: some descriptions hold a quoted line break, a doubled
# quote and separators, some lines come behind blank ones. ORDEM 0 is the header, with an unknown column.
CSV_TEXT_SQL = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY ARQUIVO ORDER BY {order}) AS ORDEM FROM {raw})
SELECT ARQUIVO, ORDEM, CASE WHEN ORDEM % 17 = 5 THEN 2 WHEN ORDEM % 23 = 0 THEN 1 ELSE 0 END AS EM_BRANCO,
  CASE WHEN ORDEM % 7 = 3 THEN 2 WHEN ORDEM % 11 = 4 THEN 1 ELSE 0 END AS QUEBRAS,
  {cells}
FROM r
"""


def _csv_cell(column: str) -> str:
    if column != "DESCRICAO":
        return f"coalesce({column}, '')"
    broken = "'\"' || coalesce(DESCRICAO, '') || chr(10) || ', \"\"x\"\",'"
    return (f"CASE WHEN ORDEM % 7 = 3 THEN {broken} || chr(10) || 'fim\"' WHEN ORDEM % 11 = 4 THEN {broken} || '\"' "
            "ELSE coalesce(DESCRICAO, '') END")


def csv_text_sql(raw: str, columns: list[str]) -> str:
    """(ARQUIVO, ORDEM, EM_BRANCO, QUEBRAS, TEXTO) of every raw line; TEXTO holds its blank lines before it."""
    row = " || ',' || ".join(_csv_cell(c) for c in [*columns, "ORDEM"])
    cells = (f"CASE WHEN ORDEM % 17 = 5 THEN chr(10) || chr(10) WHEN ORDEM % 23 = 0 THEN chr(10) ELSE '' END || {row} AS TEXTO")
    return CSV_TEXT_SQL.format(raw=raw, order=", ".join(f"{c} NULLS FIRST" for c in columns), cells=cells)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str, lot: str = LOT_BY_SUPPLIER) -> DataFrame:
    return spark.sql(RAW_SQL.format(lot=lot, lineitem="{lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def raw_by_order(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Raw lines with a lot for each order; ``parts``: dealt by lot, which moves the source's columns, narrower than the text."""
    lineitem = table(spark, sf_dir, "lineitem")
    if parts:
        lineitem = lineitem.repartition(parts, "l_orderkey")
    return spark.sql(RAW_SQL.format(lot=LOT_BY_ORDER, lineitem="{lineitem}"), lineitem=lineitem)


def led(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LED_SQL, lineitem=table(spark, sf_dir, "lineitem"))


def delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DELTA_SQL, lineitem=table(spark, sf_dir, "lineitem"))


def delta_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DELTA_DUP_SQL, delta=delta(spark, sf_dir))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EDITS_SQL, led=led(spark, sf_dir))


# ---- the same texts for DuckDB (tables are views named after the parquet files)

def sql_raw(lot: str = LOT_BY_SUPPLIER) -> str:
    return RAW_SQL.format(lot=lot, lineitem="lineitem")


def sql_led() -> str:
    return LED_SQL.format(lineitem="lineitem")


def sql_delta() -> str:
    return DELTA_SQL.format(lineitem="lineitem")


def sql_delta_dup() -> str:
    return DELTA_DUP_SQL.format(delta=f"({sql_delta()})")


def sql_edits() -> str:
    return EDITS_SQL.format(led=f"({sql_led()})")
