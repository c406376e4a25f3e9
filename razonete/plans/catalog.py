"""Registered queries: one per operator of the inventory, each with its oracle.

Every query reads the test tables (or data Spark derives from them through
the fixture SQL) in full. ``QUERIES[name](spark, sf_dir)`` returns a lazy
DataFrame; ``ORACLE[name]`` is SQL text DuckDB runs over the same parquet
files. Column names are aliased identically on both sides.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, format as fmt, numbers, text
from ..operators import audit as A
from ..operators import expect as E
from ..operators import gate as G
from ..operators import merge as M
from ..operators import mutate as MU
from ..operators import query as Q
from ..operators import report as RP
from ..operators import rules as R
from ..operators import validate as V
from ..operators.project import assign_version, cast_strings, fill_nulls, to_ledger
from ..schema import FILE_COL, LEDGER_COLUMNS, RAW_COLUMNS, normalize_headers
from . import fixtures as fx
from . import oracle as O

# ---------------------------------------------------------------- parameters
AS_OF = _dt.datetime(2025, 1, 15, 9, 30, 0)
AS_OF_SQL = "TIMESTAMP '2025-01-15 09:30:00'"
RUN_START = _dt.datetime(2025, 1, 15, 9, 0, 0)
RUN_END = _dt.datetime(2025, 1, 15, 9, 5, 17)
CTX = A.AuditContext(as_of=AS_OF, usuario="orcamento", sistema_operacional="Linux", versao_sistema="6.1")

F_LIST = Q.Filters(data_inicio="1995-03-01", data_fim="1996-09-30", versao="1996 - V2", origem="MA F")
F_EQ = Q.Filters(filial="0107", operacao="OP1", rateio="NAO")
F_RANGE = Q.Filters(data_inicio="1996-01-01", data_fim="1996-06-30")
F_LIKE = Q.Filters(origem="MA_O")
F_DELETE = Q.Filters(data_inicio="1997-01-01", data_fim="1997-12-31", rateio="NAO")
DEL_VERSION = "1995 - V2"
DEL_FILIAL = "0107"
NEW_VERSION = (2025, 2)
MESSY_HEADERS = ["filial", "Data", "N CONTA", "N centro custo", "Operação", "valor", "Descrição",
                 " tipo ", "VERSÃO", "Rateio", "origem", "Arquivo"]

# ------------------------------------------------------------- SQL sources
RAW = f"({fx.sql_raw()})"
RAWO = f"({fx.sql_raw(fx.LOT_BY_ORDER)})"
LED = f"({fx.sql_led()})"
DELTA = f"({fx.sql_delta()})"
DDUP = f"({fx.sql_delta_dup()})"
EDITS = f"({fx.sql_edits()})"
NORM = list(O.normalised_sql().keys())  # the eleven normalised columns, sheet order


def _sql_filters(f: Q.Filters) -> str:
    """SQL text of a filter set, the way the reference writes it."""
    p = ["TRUE"]
    if f.n_conta:
        p.append(f"CAST(N_CONTA AS VARCHAR) = {O.q(f.n_conta)}")
    if f.n_centro_custo:
        p.append(f"CAST(N_CENTRO_CUSTO AS VARCHAR) = {O.q(f.n_centro_custo)}")
    if f.data_inicio:
        p.append(f"DATA >= DATE {O.q(str(f.data_inicio))}")
    if f.data_fim:
        p.append(f"DATA <= DATE {O.q(str(f.data_fim))}")
    if f.versao:
        p.append(f"VERSAO = {O.q(f.versao)}")
    if f.operacao:
        p.append(f"OPERACAO = {O.q(f.operacao)}")
    if f.filial:
        p.append(f"CAST(FILIAL AS VARCHAR) = {O.q(f.filial)}")
    if f.rateio:
        p.append(f"RATEIO = {O.q(f.rateio)}")
    if f.origem:
        p.append(f"ORIGEM LIKE {O.q('%' + f.origem + '%')}")
    return " AND ".join(p)


LEDGER_SELECT = ", ".join(LEDGER_COLUMNS)


# ------------------------------------------------------------ Spark helpers
def _validated(spark, sf, lot=fx.LOT_BY_SUPPLIER, profile=R.AS_CODED) -> DataFrame:
    return V.apply_rules(fx.raw(spark, sf, lot), profile)


def _with_text(v: DataFrame) -> DataFrame:
    """Validated rows with the fault list flattened to text (for comparison)."""
    return v.select(
        FILE_COL, *NORM,
        F.col(V.N_ERR_COL).cast("long").alias("N_ERROS"),
        V.error_text().alias("ERROS_TXT"),
    )


def _accepted_ledger(spark, sf) -> DataFrame:
    v = _validated(spark, sf, fx.LOT_BY_ORDER)
    return to_ledger(G.accepted_rows(v), AS_OF, keep=[FILE_COL])


def _rule_check(spark, sf, profile, pick, outputs) -> DataFrame:
    """A validator query: selected normalised fields plus the faults of the picked rules."""
    raw = fx.raw(spark, sf)
    rules = [r for r in R.CATALOGUE if pick(r)]
    v = V.apply_rules(raw.select(*[F.col(c).alias(f"IN_{c}") for c in RAW_COLUMNS], *RAW_COLUMNS), profile,
                      rules=rules)
    return v.select(
        *outputs(v),
        F.col(V.N_ERR_COL).cast("long").alias("N_ERROS"),
        V.error_text().alias("ERROS_TXT"),
    )


def _rule_check_sql(profile, pick, outputs_sql) -> str:
    rules = [r for r in O.active_rules(profile) if pick(r)]
    n, txt = O.errors_sql(profile, rules=rules)
    return f"SELECT {outputs_sql}, {n} AS N_ERROS, {txt} AS ERROS_TXT FROM {RAW}"


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# =========================================================== S: sources
@register("scan_raw", f"SELECT * FROM {RAW}")
def q_scan_raw(spark: SparkSession, sf: str) -> DataFrame:
    return fx.raw(spark, sf)


@register("header_normalize", f"SELECT * FROM {RAW}")
def q_header_normalize(spark, sf):
    return normalize_headers(fx.raw(spark, sf).toDF(*MESSY_HEADERS))


@register("source_tag", f"""
SELECT ARQUIVO,
  regexp_extract(ARQUIVO, '^(.*?)(\\.[^.]*)?$', 1) AS BASE,
  'processado_' || regexp_extract(ARQUIVO, '^(.*?)(\\.[^.]*)?$', 1) AS PROCESSADO,
  STATUS || ': ' || ARQUIVO AS ORIGEM_AUDITORIA
FROM (SELECT ARQUIVO, CASE WHEN max(N_ERROS) > 0 THEN 'REJEITADO' ELSE 'IMPORTACAO_COMPLETA' END AS STATUS
      FROM ({O.validated_sql(RAWO)}) GROUP BY ARQUIVO)
""")
def q_source_tag(spark, sf):
    from ..sources import files

    gate = G.file_gate(_validated(spark, sf, fx.LOT_BY_ORDER))
    status = F.when(F.col("STATUS") == G.REJECTED, F.lit("REJEITADO")).otherwise(F.lit("IMPORTACAO_COMPLETA"))
    return gate.select(
        FILE_COL,
        files.base_name(F.col(FILE_COL)).alias("BASE"),
        files.processed_name(F.col(FILE_COL)).alias("PROCESSADO"),
        files.status_tag(status, F.col(FILE_COL)).alias("ORIGEM_AUDITORIA"),
    )


@register("xml_rows", f"""
SELECT N_CONTA, N_CENTRO_CUSTO, DATA, VERSAO,
  '<Registro>' || chr(10) || {' || '.join(
      f"CASE WHEN {c} IS NULL THEN '    <{c}></{c}>' || chr(10) ELSE '    <{c}>' || "
      f"replace(replace(replace({('strftime(DATA_ATUALIZACAO, ' + chr(39) + '%Y-%m-%d %H:%M:%S' + chr(39) + ')') if c == 'DATA_ATUALIZACAO' else f'CAST({c} AS VARCHAR)'}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
      f" || '</{c}>' || chr(10) END" for c in LEDGER_COLUMNS)} || '</Registro>' AS XML
FROM {LED}
""")
def q_xml_rows(spark, sf):
    from ..sources import files

    led = fx.led(spark, sf)
    return led.select("N_CONTA", "N_CENTRO_CUSTO", "DATA", "VERSAO",
                      files.xml_column(files.ledger_text(led)).alias("XML"))


# ================================================= P: projections and casts
@register("cast_strings", f"""
SELECT N_CONTA, N_CENTRO_CUSTO, DESCRICAO, VALOR, CAST(DATA AS VARCHAR) AS DATA, VERSAO, OPERACAO,
       DATA_ATUALIZACAO, FILIAL, RATEIO, ORIGEM FROM {LED}
""")
def q_cast_strings(spark, sf):
    return cast_strings(fx.led(spark, sf))


@register("fill_nulls", "SELECT ARQUIVO, " + ", ".join(
    f"coalesce({c}, 0.0) AS {c}" if c == "VALOR" else (c if c == "DATA" else f"coalesce({c}, '') AS {c}")
    for c in NORM) + f" FROM ({O.validated_sql(RAW)})")
def q_fill_nulls(spark, sf):
    return fill_nulls(_validated(spark, sf).select(FILE_COL, *NORM))


_TO_LEDGER_SQL = f"""
WITH v AS ({O.validated_sql(RAWO)}),
bad AS (SELECT DISTINCT ARQUIVO FROM v WHERE N_ERROS > 0)
SELECT ARQUIVO, coalesce(N_CONTA, '') AS N_CONTA, coalesce(N_CENTRO_CUSTO, '') AS N_CENTRO_CUSTO,
  coalesce(DESCRICAO, '') AS DESCRICAO, coalesce(VALOR, 0.0) AS VALOR, DATA, coalesce(VERSAO, '') AS VERSAO,
  coalesce(OPERACAO, '') AS OPERACAO, {AS_OF_SQL} AS DATA_ATUALIZACAO, coalesce(FILIAL, '') AS FILIAL,
  coalesce(RATEIO, '') AS RATEIO, coalesce(ORIGEM, '') AS ORIGEM
FROM v WHERE ARQUIVO NOT IN (SELECT ARQUIVO FROM bad)
"""


@register("to_ledger", _TO_LEDGER_SQL)
def q_to_ledger(spark, sf):
    return _accepted_ledger(spark, sf)


_EXPORT_SQL_COLS = {
    "N_CONTA": "N_CONTA",
    "N_CENTRO_CUSTO": "N_CENTRO_CUSTO",
    "DESCRICAO": "DESCRICAO",
    "VALOR": "'R$ ' || format('{:,.2f}', VALOR)",
    "DATA": "strftime(DATA, '%d/%m/%Y')",
    "VERSAO": "VERSAO",
    "OPERACAO": "OPERACAO",
    "DATA_ATUALIZACAO": "strftime(DATA_ATUALIZACAO, '%d/%m/%Y %H:%M:%S')",
    "FILIAL": "FILIAL",
    "RATEIO": "RATEIO",
    "ORIGEM": "ORIGEM",
}
_EXPORT_SQL = "SELECT " + ", ".join(
    f'{_EXPORT_SQL_COLS[c]} AS "{fmt.EXPORT_HEADINGS[c]}"' for c in LEDGER_COLUMNS) + f" FROM {LED}"


@register("export_view", _EXPORT_SQL)
def q_export_view(spark, sf):
    return Q.export_view(fx.led(spark, sf))


@register("list_view", f"""
SELECT FILIAL, N_CONTA, N_CENTRO_CUSTO, DESCRICAO, 'R$ ' || printf('%.2f', VALOR) AS VALOR, DATA, VERSAO,
  CASE WHEN OPERACAO IS NULL OR OPERACAO = 'nan' THEN '' ELSE OPERACAO END AS OPERACAO,
  CASE WHEN RATEIO IS NULL OR RATEIO = 'nan' THEN '' ELSE RATEIO END AS RATEIO,
  CASE WHEN ORIGEM IS NULL OR ORIGEM = 'nan' THEN '' ELSE ORIGEM END AS ORIGEM,
  DATA_ATUALIZACAO
FROM {LED}
""")
def q_list_view(spark, sf):
    return Q.list_view(fx.led(spark, sf))


@register("column_widths", "WITH e AS (" + _EXPORT_SQL + ")\n" + "\nUNION ALL\n".join(
    f"SELECT '{h}' AS COLUNA, CAST(greatest(coalesce(max(length(CAST(\"{h}\" AS VARCHAR))), 0), {len(h)}) + 2 AS BIGINT)"
    f" AS LARGURA FROM e" for h in [fmt.EXPORT_HEADINGS[c] for c in LEDGER_COLUMNS]))
def q_column_widths(spark, sf):
    w = Q.column_widths(Q.export_view(fx.led(spark, sf)))
    return w.select("COLUNA", F.col("LARGURA").cast("long").alias("LARGURA"))


@register("assign_version", f"""
SELECT N_CONTA, N_CENTRO_CUSTO, DESCRICAO, VALOR, DATA, '2025 - V2' AS VERSAO, OPERACAO, DATA_ATUALIZACAO,
       FILIAL, RATEIO, ORIGEM FROM {LED}
""")
def q_assign_version(spark, sf):
    return assign_version(fx.led(spark, sf), *NEW_VERSION)


# ================================================= N: scalar normalisers
@register("clean_text", f"SELECT doc_id, {O.clean('text')} AS TEXTO FROM documents")
def q_clean_text(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", text.clean_text("text").alias("TEXTO"))


@register("squash_upper", f"SELECT doc_id, {O.squash_upper('text')} AS TEXTO FROM documents")
def q_squash_upper(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", text.squash_upper("text").alias("TEXTO"))


@register("zfill_branch", f"SELECT FILIAL, {O.zfill('FILIAL')} AS FILIAL_4 FROM {RAW}")
def q_zfill_branch(spark, sf):
    return fx.raw(spark, sf).select("FILIAL", text.zfill_branch("FILIAL").alias("FILIAL_4"))


@register("digits_only", f"""
SELECT N_CONTA, {O.digits('N_CONTA')} AS CONTA_DIGITOS, N_CENTRO_CUSTO,
       {O.digits('N_CENTRO_CUSTO')} AS CENTRO_DIGITOS,
       TRY_CAST({O.digits('N_CONTA')} AS BIGINT) AS CONTA_NUM FROM {RAW}
""")
def q_digits_only(spark, sf):
    return fx.raw(spark, sf).select(
        "N_CONTA", text.digits_only("N_CONTA").alias("CONTA_DIGITOS"),
        "N_CENTRO_CUSTO", text.digits_only("N_CENTRO_CUSTO").alias("CENTRO_DIGITOS"),
        text.digits_only("N_CONTA").try_cast("bigint").alias("CONTA_NUM"),
    )


@register("default_tipo", f"SELECT TIPO, {O.default_tipo('TIPO')} AS TIPO_NORM FROM {RAW}")
def q_default_tipo(spark, sf):
    return fx.raw(spark, sf).select("TIPO", text.default_tipo("TIPO").alias("TIPO_NORM"))


@register("normalize_rateio", f"SELECT RATEIO, {O.normalize_rateio('RATEIO')} AS RATEIO_NORM FROM {RAW}")
def q_normalize_rateio(spark, sf):
    return fx.raw(spark, sf).select("RATEIO", text.normalize_rateio("RATEIO").alias("RATEIO_NORM"))


@register("parse_date", f"""
SELECT DATA, {O.parse_date('DATA')} AS DATA_DATE, strftime({O.parse_date('DATA')}, '%d/%m/%Y') AS DATA_BR FROM {RAW}
""")
def q_parse_date(spark, sf):
    d = dates.parse_date("DATA")
    return fx.raw(spark, sf).select("DATA", d.alias("DATA_DATE"), dates.canonical_date(d).alias("DATA_BR"))


FLEX_INPUT_SQL = """
SELECT o_orderkey,
  CASE WHEN o_orderkey % 97 = 0 THEN 'sem data'
       WHEN o_orderkey % 4 = 0 THEN CAST(year(o_orderdate) AS STRING) || '-' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '-' || lpad(CAST(day(o_orderdate) AS STRING), 2, '0')
       WHEN o_orderkey % 4 = 1 THEN lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/' || CAST(year(o_orderdate) AS STRING)
       WHEN o_orderkey % 4 = 2 THEN CAST(year(o_orderdate) AS STRING) || '/' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(day(o_orderdate) AS STRING), 2, '0')
       ELSE lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '-' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '-' || CAST(year(o_orderdate) AS STRING) END AS DATA_TEXTO
FROM {orders}
"""


@register("parse_date_flex", f"""
SELECT o_orderkey, DATA_TEXTO, {O.parse_date('DATA_TEXTO', O.FLEX_FORMATS)} AS DATA
FROM ({FLEX_INPUT_SQL.format(orders='orders')})
""")
def q_parse_date_flex(spark, sf):
    src = spark.sql(FLEX_INPUT_SQL, orders=fx.table(spark, sf, "orders"))
    return src.select("o_orderkey", "DATA_TEXTO", dates.parse_date_flex("DATA_TEXTO").alias("DATA"))


@register("parse_valor", f"SELECT VALOR, {O.parse_valor('VALOR')} AS VALOR_NUM FROM {RAW}")
def q_parse_valor(spark, sf):
    return fx.raw(spark, sf).select("VALOR", numbers.parse_valor("VALOR").alias("VALOR_NUM"))


BR_INPUT_SQL = """
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_orderkey % 2 = 0 THEN replace(CAST(l_extendedprice AS STRING), '.', ',')
       WHEN l_linenumber = 2 THEN CAST(l_extendedprice AS STRING) || 'x'
       ELSE CAST(l_extendedprice AS STRING) END AS VALOR_TEXTO
FROM {lineitem}
"""


@register("parse_valor_br", f"""
SELECT l_orderkey, l_linenumber, VALOR_TEXTO, {O.parse_valor_br('VALOR_TEXTO')} AS VALOR
FROM ({BR_INPUT_SQL.format(lineitem='lineitem')})
""")
def q_parse_valor_br(spark, sf):
    src = spark.sql(BR_INPUT_SQL, lineitem=fx.table(spark, sf, "lineitem"))
    return src.select("l_orderkey", "l_linenumber", "VALOR_TEXTO", numbers.parse_valor_br("VALOR_TEXTO").alias("VALOR"))


# ================================================= V: row validators
def _field_pick(*fields):
    return lambda r: r.field in fields


def _validator(name, profile, pick, spark_out, sql_out):
    register(name, _rule_check_sql(profile, pick, sql_out))(
        lambda spark, sf: _rule_check(spark, sf, profile, pick, spark_out))


_validator("validate_filial", R.AS_CODED, _field_pick("FILIAL"),
           lambda v: [F.col("IN_FILIAL").alias("FILIAL_ENTRADA"), "FILIAL"],
           f"FILIAL AS FILIAL_ENTRADA, {O.normalised_sql()['FILIAL']} AS FILIAL")
_validator("validate_conta", R.DOCUMENTED, _field_pick("N_CONTA"),
           lambda v: ["N_CONTA"], "N_CONTA")
_validator("validate_centro_custo", R.DOCUMENTED, _field_pick("N_CENTRO_CUSTO"),
           lambda v: ["N_CONTA", "N_CENTRO_CUSTO"], "N_CONTA, N_CENTRO_CUSTO")
_validator("validate_operacao", R.AS_CODED, _field_pick("OPERACAO"),
           lambda v: [F.col("IN_OPERACAO").alias("OPERACAO_ENTRADA"), "OPERACAO"],
           f"OPERACAO AS OPERACAO_ENTRADA, {O.normalised_sql()['OPERACAO']} AS OPERACAO")
_validator("validate_rateio", R.AS_CODED, _field_pick("RATEIO"),
           lambda v: [F.col("IN_RATEIO").alias("RATEIO_ENTRADA"), "RATEIO"],
           f"RATEIO AS RATEIO_ENTRADA, {O.normalised_sql()['RATEIO']} AS RATEIO")
_validator("validate_origem", R.AS_CODED, _field_pick("ORIGEM"),
           lambda v: [F.col("IN_ORIGEM").alias("ORIGEM_ENTRADA"), "ORIGEM"],
           f"ORIGEM AS ORIGEM_ENTRADA, {O.normalised_sql()['ORIGEM']} AS ORIGEM")
_validator("validate_valor", R.AS_CODED, _field_pick("VALOR"),
           lambda v: [F.col("IN_VALOR").alias("VALOR_ENTRADA"), "VALOR"],
           f"VALOR AS VALOR_ENTRADA, {O.normalised_sql()['VALOR']} AS VALOR")
_validator("validate_descricao", R.AS_CODED, _field_pick("DESCRICAO"),
           lambda v: ["DESCRICAO"], f"{O.normalised_sql()['DESCRICAO']} AS DESCRICAO")
_validator("validate_versao", R.DOCUMENTED, _field_pick("VERSAO"),
           lambda v: [F.col("IN_VERSAO").alias("VERSAO_ENTRADA"), "VERSAO"],
           f"VERSAO AS VERSAO_ENTRADA, {O.normalised_sql(R.DOCUMENTED)['VERSAO']} AS VERSAO")
_validator("validate_data", R.AS_CODED, _field_pick("DATA"),
           lambda v: [F.col("IN_DATA").alias("DATA_ENTRADA"), "DATA"],
           f"DATA AS DATA_ENTRADA, {O.normalised_sql()['DATA']} AS DATA")
_validator("validate_documented", R.DOCUMENTED, lambda r: r.rule_id.startswith("V12."),
           lambda v: ["FILIAL", "VALOR", "DESCRICAO"],
           ", ".join(f"{O.normalised_sql(R.DOCUMENTED)[c]} AS {c}" for c in ("FILIAL", "VALOR", "DESCRICAO")))


# ================================================= G: transform and gates
@register("transform_rows", f"SELECT * FROM ({O.validated_sql(RAW)})")
def q_transform_rows(spark, sf):
    return _with_text(_validated(spark, sf))


@register("transform_rows_documented", f"SELECT * FROM ({O.validated_sql(RAW, R.DOCUMENTED)})")
def q_transform_rows_documented(spark, sf):
    """G2 under the documented profile (all written rules, comma decimals, cleaned version)."""
    return _with_text(_validated(spark, sf, profile=R.DOCUMENTED))


_ORDER_ALL = ", ".join(f"{c} ASC NULLS FIRST" for c in RAW_COLUMNS)


def error_lines_sql(numbered: str) -> str:
    """G3 over numbered raw lines (ARQUIVO, LINHA and the sheet's columns)."""
    rules = O.active_rules(R.AS_CODED)
    flags = ",\n  ".join(f"CAST({O.rule_sql(r.rule_id)} AS INTEGER) AS b{i}" for i, r in enumerate(rules))
    parts = []
    for i, r in enumerate(rules):
        before = " + ".join([f"b{j}" for j in range(i)]) or "0"
        parts.append(
            f"SELECT ARQUIVO, LINHA, CAST(1 + {before} AS INTEGER) AS ORDEM, {O.q(r.field)} AS CAMPO, "
            f"{O.q(r.rule_id)} AS REGRA, {O.q(r.message)} AS MENSAGEM, "
            f"'Linha ' || CAST(LINHA AS VARCHAR) || ': ' || {O.q(r.message)} AS ERRO FROM f WHERE b{i} = 1"
        )
    return (
        f"WITH n AS ({numbered}),\nf AS (SELECT ARQUIVO, LINHA,\n  {flags} FROM n)\n" + "\nUNION ALL\n".join(parts)
    )


_NUMBERED = f"SELECT *, CAST(row_number() OVER (PARTITION BY ARQUIVO ORDER BY {_ORDER_ALL}) + 1 AS BIGINT) AS LINHA FROM {RAW}"


@register("error_lines", error_lines_sql(_NUMBERED))
def q_error_lines(spark, sf):
    raw = fx.raw(spark, sf)
    numbered = V.line_numbers_by_content(raw, FILE_COL, RAW_COLUMNS)
    return V.error_lines(V.apply_rules(numbered))


_V_ORDER = f"({O.validated_sql(RAWO)})"


@register("file_gate", f"""
SELECT ARQUIVO, count(*) AS TOTAL_LINHAS, count_if(N_ERROS > 0) AS LINHAS_COM_ERRO,
  CAST(sum(N_ERROS) AS BIGINT) AS TOTAL_ERROS,
  CASE WHEN count_if(N_ERROS > 0) > 0 THEN 'REJEITADO' ELSE 'ACEITO' END AS STATUS
FROM {_V_ORDER} GROUP BY ARQUIVO
""")
def q_file_gate(spark, sf):
    return G.file_gate(_validated(spark, sf, fx.LOT_BY_ORDER))


@register("file_gate_documented", f"""
SELECT ARQUIVO, count(*) AS TOTAL_LINHAS, count_if(N_ERROS > 0) AS LINHAS_COM_ERRO,
  CAST(sum(N_ERROS) AS BIGINT) AS TOTAL_ERROS,
  CASE WHEN count_if(N_ERROS > 0) > 0 THEN 'REJEITADO' ELSE 'ACEITO' END AS STATUS
FROM ({O.validated_sql(RAWO, R.DOCUMENTED)}) GROUP BY ARQUIVO
""")
def q_file_gate_documented(spark, sf):
    """G4 under the documented profile: the never-called validators and the written extras also reject lots."""
    return G.file_gate(_validated(spark, sf, fx.LOT_BY_ORDER, R.DOCUMENTED))


@register("accepted_rows", f"""
WITH v AS {_V_ORDER}
SELECT * FROM v WHERE ARQUIVO NOT IN (SELECT ARQUIVO FROM v WHERE N_ERROS > 0)
""")
def q_accepted_rows(spark, sf):
    return _with_text(G.accepted_rows(_validated(spark, sf, fx.LOT_BY_ORDER)))


@register("rejected_rows", f"""
WITH v AS {_V_ORDER}
SELECT * FROM v WHERE ARQUIVO IN (SELECT ARQUIVO FROM v WHERE N_ERROS > 0)
""")
def q_rejected_rows(spark, sf):
    return _with_text(G.rejected_rows(_validated(spark, sf, fx.LOT_BY_ORDER)))


@register("gate_centro_custo", f"""
SELECT ARQUIVO, count(*) AS TOTAL, count_if(length(N_CENTRO_CUSTO) <> 9) AS CENTROS_INVALIDOS,
  count_if(length(N_CENTRO_CUSTO) <> 9) = 0 AS OK
FROM ({_TO_LEDGER_SQL}) GROUP BY ARQUIVO
""")
def q_gate_centro_custo(spark, sf):
    return G.gate_centro_custo(_accepted_ledger(spark, sf), FILE_COL)


_PROFILE_COLS = [c for c in LEDGER_COLUMNS if c != "DATA_ATUALIZACAO"]


@register("gate_profile", "WITH v AS " + _V_ORDER + ",\na AS (SELECT * FROM v WHERE ARQUIVO NOT IN "
          "(SELECT ARQUIVO FROM v WHERE N_ERROS > 0))\n" + "\nUNION ALL\n".join(
              f"SELECT '{c}' AS COLUNA, count(*) AS TOTAL, count_if({c} IS NULL) AS NULOS, "
              f"count(*) > 0 AND count_if({c} IS NULL) = 0 AS OK FROM a" for c in _PROFILE_COLS))
def q_gate_profile(spark, sf):
    return G.gate_profile(G.accepted_rows(_validated(spark, sf, fx.LOT_BY_ORDER)), _PROFILE_COLS)


# ================================================= E: expectation suite
def _expect_sql() -> str:
    src = "(SELECT o_orderkey AS codigo, o_orderpriority AS descricao, o_totalprice AS valor, o_orderdate AS data FROM orders)"
    rows = []
    for i, e in enumerate(E.suite_from_config()):
        if e.kind in (E.EXISTS, E.OF_TYPE):
            bad = "0"
        elif e.kind == E.NOT_NULL:
            bad = f"count_if({e.column} IS NULL)"
        elif e.kind == E.GREATER:
            bad = f"count_if({e.column} <= {e.arg})"
        else:
            bad = f"count_if(NOT regexp_matches(CAST({e.column} AS VARCHAR), {O.q(e.arg)}))"
        rows.append(f"SELECT CAST({i + 1} AS INTEGER) AS ORDEM, '{e.kind}' AS EXPECTATIVA, '{e.column}' AS COLUNA, "
                    f"count(*) AS TOTAL, CAST({bad} AS BIGINT) AS FALHAS, CAST({bad} AS BIGINT) = 0 AS SUCESSO FROM {src}")
    return "\nUNION ALL\n".join(rows)


@register("expect_suite", _expect_sql())
def q_expect_suite(spark, sf):
    return E.run_suite(E.expectation_input(spark, fx.table(spark, sf, "orders")), E.suite_from_config())


# ================================================= U: merge family
@register("version_counts", f"""
SELECT b.VERSAO, CAST(coalesce(t.n, 0) AS BIGINT) AS REGISTROS_EXISTENTES
FROM (SELECT DISTINCT VERSAO FROM {DELTA}) b
LEFT JOIN (SELECT VERSAO, count(*) AS n FROM {LED} GROUP BY VERSAO) t ON b.VERSAO = t.VERSAO
""")
def q_version_counts(spark, sf):
    return M.version_counts(fx.led(spark, sf), fx.delta(spark, sf))


@register("import_mode", f"""
SELECT b.VERSAO, CAST(coalesce(t.n, 0) AS BIGINT) AS REGISTROS_EXISTENTES, b.TOTAL_REGISTROS,
  CASE WHEN coalesce(t.n, 0) = 0 THEN 'IMPORTACAO_COMPLETA' ELSE 'ATUALIZACAO_PARCIAL' END AS STATUS
FROM (SELECT VERSAO, count(*) AS TOTAL_REGISTROS FROM {DELTA} GROUP BY VERSAO) b
LEFT JOIN (SELECT VERSAO, count(*) AS n FROM {LED} GROUP BY VERSAO) t ON b.VERSAO = t.VERSAO
""")
def q_import_mode(spark, sf):
    return M.import_mode(fx.led(spark, sf), fx.delta(spark, sf))


@register("replace_version", f"SELECT * FROM {LED} WHERE VERSAO NOT IN (SELECT VERSAO FROM {DELTA})")
def q_replace_version(spark, sf):
    return M.replace_version(fx.led(spark, sf), fx.delta(spark, sf))


@register("dedup_latest", f"""
SELECT {LEDGER_SELECT} FROM (
  SELECT *, row_number() OVER (PARTITION BY N_CONTA, N_CENTRO_CUSTO, DATA, VERSAO
    ORDER BY DATA_ATUALIZACAO DESC NULLS LAST, DESCRICAO DESC NULLS LAST, VALOR DESC NULLS LAST,
             OPERACAO DESC NULLS LAST, FILIAL DESC NULLS LAST, RATEIO DESC NULLS LAST, ORIGEM DESC NULLS LAST) AS rn
  FROM {DDUP}) WHERE rn = 1
""")
def q_dedup_latest(spark, sf):
    return M.dedup_latest(fx.delta_dup(spark, sf))


_MERGE_SQL = f"""
SELECT {LEDGER_SELECT} FROM {LED} t
WHERE NOT EXISTS (SELECT 1 FROM {DELTA} s WHERE s.N_CONTA = t.N_CONTA AND s.N_CENTRO_CUSTO = t.N_CENTRO_CUSTO
                  AND s.DATA = t.DATA AND s.VERSAO = t.VERSAO)
UNION ALL
SELECT N_CONTA, N_CENTRO_CUSTO, DESCRICAO, VALOR, DATA, VERSAO, OPERACAO, {AS_OF_SQL} AS DATA_ATUALIZACAO,
       FILIAL, RATEIO, ORIGEM FROM {DELTA}
"""


@register("merge_upsert", _MERGE_SQL)
def q_merge_upsert(spark, sf):
    return M.merge_upsert(fx.led(spark, sf), fx.delta(spark, sf), as_of=AS_OF)


@register("merge_dedup", f"""
WITH s AS MATERIALIZED (
  SELECT N_CONTA, N_CENTRO_CUSTO, DATA, VERSAO,
    max({{'a': DATA_ATUALIZACAO, 'd': coalesce(DESCRICAO, ''), 'v': VALOR, 'o': coalesce(OPERACAO, ''), 'f': coalesce(FILIAL, ''),
         'r': coalesce(RATEIO, ''), 'g': coalesce(ORIGEM, ''),
         'row': {{'d': DESCRICAO, 'v': VALOR, 'o': OPERACAO, 'f': FILIAL, 'r': RATEIO, 'g': ORIGEM}}}}) AS m
  FROM {DDUP} GROUP BY N_CONTA, N_CENTRO_CUSTO, DATA, VERSAO)
SELECT {LEDGER_SELECT} FROM {LED} t ANTI JOIN s USING (N_CONTA, N_CENTRO_CUSTO, DATA, VERSAO)
UNION ALL
SELECT N_CONTA, N_CENTRO_CUSTO, m['row'].d AS DESCRICAO, m['row'].v AS VALOR, DATA, VERSAO, m['row'].o AS OPERACAO,
       {AS_OF_SQL} AS DATA_ATUALIZACAO, m['row'].f AS FILIAL, m['row'].r AS RATEIO, m['row'].g AS ORIGEM FROM s
""")
def q_merge_dedup(spark, sf):
    return M.merge_upsert(fx.led(spark, sf), fx.delta_dup(spark, sf), as_of=AS_OF)


@register("merge_replace", f"""
SELECT {LEDGER_SELECT} FROM {LED} WHERE VERSAO NOT IN (SELECT VERSAO FROM {DELTA})
UNION ALL
SELECT N_CONTA, N_CENTRO_CUSTO, DESCRICAO, VALOR, DATA, VERSAO, OPERACAO, {AS_OF_SQL} AS DATA_ATUALIZACAO,
       FILIAL, RATEIO, ORIGEM FROM {DELTA}
""")
def q_merge_replace(spark, sf):
    return M.merge_upsert(fx.led(spark, sf), fx.delta(spark, sf), as_of=AS_OF, mode=M.MODE_REPLACE)


@register("merge_actions", f"""
SELECT coalesce(t.VERSAO, s.VERSAO) AS VERSAO,
  CASE WHEN t.k IS NOT NULL AND s.k IS NOT NULL THEN 'ATUALIZADO' WHEN s.k IS NOT NULL THEN 'INSERIDO'
       ELSE 'MANTIDO' END AS ACAO,
  count(*) AS REGISTROS
FROM (SELECT N_CONTA, N_CENTRO_CUSTO, DATA, VERSAO, 1 AS k FROM {LED}) t
FULL OUTER JOIN (SELECT N_CONTA, N_CENTRO_CUSTO, DATA, VERSAO, 1 AS k FROM {DELTA}) s
  ON t.N_CONTA = s.N_CONTA AND t.N_CENTRO_CUSTO = s.N_CENTRO_CUSTO AND t.DATA = s.DATA AND t.VERSAO = s.VERSAO
GROUP BY 1, 2
""")
def q_merge_actions(spark, sf):
    return M.merge_actions(fx.led(spark, sf), fx.delta(spark, sf))


@register("duplicate_keys", f"""
SELECT N_CONTA, N_CENTRO_CUSTO, DATA, VERSAO, count(*) AS OCORRENCIAS FROM {DDUP}
GROUP BY N_CONTA, N_CENTRO_CUSTO, DATA, VERSAO HAVING count(*) > 1
""")
def q_duplicate_keys(spark, sf):
    return M.duplicate_keys(fx.delta_dup(spark, sf))


# ================================================= Q: query surface
@register("ledger_filter", f"SELECT * FROM {LED} WHERE {_sql_filters(F_LIST)}")
def q_ledger_filter(spark, sf):
    return Q.ledger_filter(fx.led(spark, sf), F_LIST)


@register("filter_eq", f"SELECT * FROM {LED} WHERE {_sql_filters(F_EQ)}")
def q_filter_eq(spark, sf):
    return Q.ledger_filter(fx.led(spark, sf), F_EQ)


@register("filter_date_range", f"SELECT * FROM {LED} WHERE {_sql_filters(F_RANGE)}")
def q_filter_date_range(spark, sf):
    return Q.ledger_filter(fx.led(spark, sf), F_RANGE)


@register("filter_like", f"SELECT * FROM {LED} WHERE {_sql_filters(F_LIKE)}")
def q_filter_like(spark, sf):
    return Q.ledger_filter(fx.led(spark, sf), F_LIKE)


@register("filtered_count", f"SELECT count(*) AS TOTAL FROM {LED} WHERE {_sql_filters(F_LIST)}")
def q_filtered_count(spark, sf):
    return Q.filtered_count(fx.led(spark, sf), F_LIST)


@register("latest_100", f"""
SELECT * FROM {LED} ORDER BY DATA_ATUALIZACAO DESC, N_CONTA, N_CENTRO_CUSTO, DATA, VERSAO LIMIT 100
""")
def q_latest_100(spark, sf):
    return Q.latest(fx.led(spark, sf))


@register("latest_100_merged", f"""
SELECT * FROM ({_MERGE_SQL}) ORDER BY DATA_ATUALIZACAO DESC, N_CONTA, N_CENTRO_CUSTO, DATA, VERSAO LIMIT 100
""")
def q_latest_100_merged(spark, sf):
    return Q.latest(M.merge_upsert(fx.led(spark, sf), fx.delta(spark, sf), as_of=AS_OF))


@register("distinct_versions", f"SELECT DISTINCT VERSAO FROM {LED}")
def q_distinct_versions(spark, sf):
    return Q.distinct_versions(fx.led(spark, sf))


# ================================================= M: mutations
_LOOKUPS = f"""
SELECT N_CONTA, N_CENTRO_CUSTO, DATA, VERSAO FROM {EDITS}
UNION ALL
SELECT N_CONTA, N_CENTRO_CUSTO, DATA, VERSAO FROM {DELTA} WHERE CAST(N_CENTRO_CUSTO AS BIGINT) % 50 = 2
"""
LOOKUPS_SPARK = """
SELECT N_CONTA, N_CENTRO_CUSTO, DATA, VERSAO FROM {edits}
UNION ALL
SELECT N_CONTA, N_CENTRO_CUSTO, DATA, VERSAO FROM {delta} WHERE CAST(N_CENTRO_CUSTO AS BIGINT) % 50 = 2
"""
_EDIT_OLD = [c for c in ["FILIAL", "N_CONTA", "N_CENTRO_CUSTO", "DESCRICAO", "VALOR", "OPERACAO", "RATEIO", "ORIGEM"]
             if c not in ("N_CONTA", "N_CENTRO_CUSTO")]


@register("edit_lookup", f"""
SELECT k.N_CONTA, k.N_CENTRO_CUSTO, k.DATA, k.VERSAO, t.N_CONTA IS NOT NULL AS ENCONTRADO,
  {', '.join(f't.{c} AS ATUAL_{c}' for c in _EDIT_OLD)},
  CASE WHEN t.N_CONTA IS NULL THEN 'Registro não encontrado' END AS MENSAGEM
FROM ({_LOOKUPS}) k LEFT JOIN {LED} t
  ON k.N_CONTA = t.N_CONTA AND k.N_CENTRO_CUSTO = t.N_CENTRO_CUSTO AND k.DATA = t.DATA AND k.VERSAO = t.VERSAO
""")
def q_edit_lookup(spark, sf):
    keys = spark.sql(LOOKUPS_SPARK, edits=fx.edits(spark, sf), delta=fx.delta(spark, sf))
    return MU.edit_lookup(fx.led(spark, sf), keys)


def _edit_diff_sql() -> str:
    parts = []
    for c in ["FILIAL", "N_CONTA", "N_CENTRO_CUSTO", "DESCRICAO", "VALOR", "OPERACAO", "RATEIO", "ORIGEM"]:
        old, new = f"t.{c}", f"e.NOVO_{c}"
        if c == "VALOR":
            shown = (f"'VALOR: ' || coalesce(CAST({old} AS VARCHAR), 'None') || ' -> ' || "
                     f"coalesce(CAST({new} AS VARCHAR), 'None')")
        else:
            shown = (f"'{c}: ''' || coalesce(CAST({old} AS VARCHAR), 'None') || ''' -> ''' || "
                     f"coalesce(CAST({new} AS VARCHAR), 'None') || ''''")
        parts.append(f"CASE WHEN {old} IS DISTINCT FROM {new} THEN {shown} END")
    return f"""
SELECT e.N_CONTA, e.N_CENTRO_CUSTO, e.DATA, e.VERSAO, e.NOVO_N_CONTA, e.NOVO_N_CENTRO_CUSTO,
  concat_ws(', ', {', '.join(parts)}) AS ALTERACOES
FROM {EDITS} e JOIN {LED} t
  ON e.N_CONTA = t.N_CONTA AND e.N_CENTRO_CUSTO = t.N_CENTRO_CUSTO AND e.DATA = t.DATA AND e.VERSAO = t.VERSAO
"""


@register("edit_diff", _edit_diff_sql())
def q_edit_diff(spark, sf):
    return MU.edit_diff(fx.led(spark, sf), fx.edits(spark, sf))


@register("apply_edits", f"""
SELECT CASE WHEN e.N_CONTA IS NULL THEN t.N_CONTA ELSE e.NOVO_N_CONTA END AS N_CONTA, CASE WHEN e.N_CONTA IS NULL THEN t.N_CENTRO_CUSTO ELSE e.NOVO_N_CENTRO_CUSTO END AS N_CENTRO_CUSTO,
  CASE WHEN e.N_CONTA IS NULL THEN t.DESCRICAO ELSE e.NOVO_DESCRICAO END AS DESCRICAO,
  CASE WHEN e.N_CONTA IS NULL THEN t.VALOR ELSE e.NOVO_VALOR END AS VALOR,
  t.DATA, t.VERSAO,
  CASE WHEN e.N_CONTA IS NULL THEN t.OPERACAO ELSE e.NOVO_OPERACAO END AS OPERACAO,
  CASE WHEN e.N_CONTA IS NULL THEN t.DATA_ATUALIZACAO ELSE {AS_OF_SQL} END AS DATA_ATUALIZACAO,
  CASE WHEN e.N_CONTA IS NULL THEN t.FILIAL ELSE e.NOVO_FILIAL END AS FILIAL,
  CASE WHEN e.N_CONTA IS NULL THEN t.RATEIO ELSE e.NOVO_RATEIO END AS RATEIO,
  CASE WHEN e.N_CONTA IS NULL THEN t.ORIGEM ELSE e.NOVO_ORIGEM END AS ORIGEM
FROM {LED} t LEFT JOIN {EDITS} e
  ON e.N_CONTA = t.N_CONTA AND e.N_CENTRO_CUSTO = t.N_CENTRO_CUSTO AND e.DATA = t.DATA AND e.VERSAO = t.VERSAO
""")
def q_apply_edits(spark, sf):
    return MU.apply_edits(fx.led(spark, sf), fx.edits(spark, sf), as_of=AS_OF)


@register("delete_keys", f"""
SELECT * FROM {LED} t WHERE NOT EXISTS (SELECT 1 FROM {EDITS} e WHERE e.N_CONTA = t.N_CONTA
  AND e.N_CENTRO_CUSTO = t.N_CENTRO_CUSTO AND e.DATA = t.DATA AND e.VERSAO = t.VERSAO)
""")
def q_delete_keys(spark, sf):
    return MU.delete_keys(fx.led(spark, sf), fx.edits(spark, sf))


@register("delete_version", f"SELECT * FROM {LED} WHERE NOT coalesce(VERSAO = '{DEL_VERSION}', false)")
def q_delete_version(spark, sf):
    return MU.delete_version(fx.led(spark, sf), DEL_VERSION)


@register("delete_filial", f"SELECT * FROM {LED} WHERE NOT coalesce(FILIAL = '{DEL_FILIAL}', false)")
def q_delete_filial(spark, sf):
    return MU.delete_filial(fx.led(spark, sf), DEL_FILIAL)


@register("delete_filtered", f"SELECT * FROM {LED} WHERE NOT coalesce(({_sql_filters(F_DELETE)}), false)")
def q_delete_filtered(spark, sf):
    return MU.delete_filtered(fx.led(spark, sf), F_DELETE)


# ================================================= A: audit
_AUDIT_HEAD = (f"{AS_OF_SQL} AS DATA_IMPORTACAO, {O.q(CTX.usuario)} AS USUARIO, "
               f"{O.q(CTX.sistema_operacional)} AS SISTEMA_OPERACIONAL, {O.q(CTX.versao_sistema)} AS VERSAO_SISTEMA")
DELTA_FILES_SPARK = "SELECT *, 'lote_' || FILIAL || '.csv' AS ARQUIVO FROM {delta}"


@register("audit_import", f"""
WITH b AS (SELECT *, 'lote_' || FILIAL || '.csv' AS ARQUIVO FROM {DELTA}),
m AS (SELECT v.VERSAO, CASE WHEN coalesce(t.n, 0) = 0 THEN 'IMPORTACAO_COMPLETA' ELSE 'ATUALIZACAO_PARCIAL' END AS STATUS
      FROM (SELECT DISTINCT VERSAO FROM b) v LEFT JOIN (SELECT VERSAO, count(*) AS n FROM {LED} GROUP BY VERSAO) t
      ON v.VERSAO = t.VERSAO),
p AS (SELECT ARQUIVO, VERSAO, count(*) AS n FROM b GROUP BY ARQUIVO, VERSAO)
SELECT {_AUDIT_HEAD}, m.STATUS || ': ' || p.ARQUIVO AS ARQUIVO_ORIGEM, CAST(p.n AS BIGINT) AS TOTAL_REGISTROS,
  m.STATUS AS STATUS,
  CASE WHEN m.STATUS = 'IMPORTACAO_COMPLETA' THEN 'Importação completa' ELSE 'Atualização parcial' END
    || ' de ' || CAST(p.n AS VARCHAR) || ' registros da versão ' || p.VERSAO AS DETALHES
FROM p JOIN m ON p.VERSAO = m.VERSAO
""")
def q_audit_import(spark, sf):
    batch = spark.sql(DELTA_FILES_SPARK, delta=fx.delta(spark, sf))
    return A.audit_import(batch, fx.led(spark, sf), CTX)


@register("audit_edit", f"""
SELECT {_AUDIT_HEAD},
  'EDITADO: ' || NOVO_N_CONTA || '/' || NOVO_N_CENTRO_CUSTO || '/' || CAST(DATA AS VARCHAR) || '/' || VERSAO AS ARQUIVO_ORIGEM,
  CAST(1 AS BIGINT) AS TOTAL_REGISTROS, 'EDITADO' AS STATUS, 'Alterações: ' || ALTERACOES AS DETALHES
FROM ({_edit_diff_sql()}) WHERE ALTERACOES <> ''
""")
def q_audit_edit(spark, sf):
    return A.audit_edit(MU.edit_diff(fx.led(spark, sf), fx.edits(spark, sf)), CTX)


@register("audit_delete", f"""
SELECT {_AUDIT_HEAD},
  'DELETADO: ' || k.N_CONTA || '/' || k.N_CENTRO_CUSTO || '/' || CAST(k.DATA AS VARCHAR) || '/' || k.VERSAO AS ARQUIVO_ORIGEM,
  CAST(coalesce(c.n, 0) AS BIGINT) AS TOTAL_REGISTROS, 'DELETADO' AS STATUS, 'Registro deletado manualmente' AS DETALHES
FROM ({_LOOKUPS}) k LEFT JOIN (SELECT N_CONTA, N_CENTRO_CUSTO, DATA, VERSAO, count(*) AS n FROM {LED}
  GROUP BY N_CONTA, N_CENTRO_CUSTO, DATA, VERSAO) c
  ON k.N_CONTA = c.N_CONTA AND k.N_CENTRO_CUSTO = c.N_CENTRO_CUSTO AND k.DATA = c.DATA AND k.VERSAO = c.VERSAO
UNION ALL
SELECT {_AUDIT_HEAD}, 'DELETADO: Filial {DEL_FILIAL}', CAST(count_if(FILIAL = '{DEL_FILIAL}') AS BIGINT), 'DELETADO',
  'Registros deletados para filial {DEL_FILIAL}' FROM {LED}
UNION ALL
SELECT {_AUDIT_HEAD}, 'DELETADO: Versão {DEL_VERSION}', CAST(count_if(VERSAO = '{DEL_VERSION}') AS BIGINT), 'DELETADO',
  'Registros deletados da versão {DEL_VERSION}' FROM {LED}
UNION ALL
SELECT {_AUDIT_HEAD}, 'DELETADO: Filtros aplicados', CAST(count_if(coalesce(({_sql_filters(F_DELETE)}), false)) AS BIGINT),
  'DELETADO', {O.q(A.DETAIL_DELETE_FILTERS + A.filters_text(F_DELETE))} FROM {LED}
""")
def q_audit_delete(spark, sf):
    led = fx.led(spark, sf)
    keys = spark.sql(LOOKUPS_SPARK, edits=fx.edits(spark, sf), delta=fx.delta(spark, sf))
    return (
        A.audit_delete_keys(led, keys, CTX)
        .unionByName(A.audit_delete_filial(led, DEL_FILIAL, CTX))
        .unionByName(A.audit_delete_version(led, DEL_VERSION, CTX))
        .unionByName(A.audit_delete_filtered(led, F_DELETE, CTX))
    )


# ================================================= R: metrics and reports
@register("lot_metrics", f"""
SELECT ARQUIVO, count(*) AS TOTAL_LINHAS, count_if(N_ERROS > 0) AS LINHAS_COM_ERRO,
  CASE WHEN count_if(N_ERROS > 0) > 0 THEN 'REJEITADO' ELSE 'ACEITO' END AS RESULTADO,
  TIMESTAMP '{RUN_START:%Y-%m-%d %H:%M:%S}' AS INICIO, TIMESTAMP '{RUN_END:%Y-%m-%d %H:%M:%S}' AS FIM,
  CAST({(RUN_END - RUN_START).total_seconds()} AS DOUBLE) AS DURACAO_S
FROM {_V_ORDER} GROUP BY ARQUIVO
""")
def q_lot_metrics(spark, sf):
    return RP.lot_metrics(_validated(spark, sf, fx.LOT_BY_ORDER), RUN_START, RUN_END)


def _summary_sql() -> str:
    rules = O.active_rules(R.AS_CODED)
    parts = [f"SELECT {O.q(r.field)} AS CAMPO, {O.q(r.rule_id)} AS REGRA, {O.q(r.message)} AS MENSAGEM, "
             f"count_if({O.rule_sql(r.rule_id)}) AS OCORRENCIAS FROM {RAW}" for r in rules]
    return "SELECT * FROM (" + "\nUNION ALL\n".join(parts) + ") WHERE OCORRENCIAS > 0"


@register("validation_summary", _summary_sql())
def q_validation_summary(spark, sf):
    return RP.validation_summary(_validated(spark, sf))


@register("validation_totals", f"""
SELECT count(*) AS TOTAL, count_if(N_ERROS = 0) AS PROCESSADOS, count_if(N_ERROS > 0) AS COM_ERRO,
  CAST(coalesce(sum(N_ERROS), 0) AS BIGINT) AS ERROS FROM ({O.validated_sql(RAW)})
""")
def q_validation_totals(spark, sf):
    return RP.validation_totals(_validated(spark, sf))


def _totals(out: DataFrame) -> DataFrame:
    """The columns of the oracle; a total that is not the sum of all its rows is null there."""
    return out.select("VERSAO", "FILIAL", "NIVEL", "REGISTROS", F.col("TOTAL_VALOR").cast("decimal(38,2)").alias("TOTAL_VALOR"))


@register("totals_by_category", f"""
SELECT VERSAO, FILIAL, CAST(grouping(VERSAO, FILIAL) AS INTEGER) AS NIVEL, count(*) AS REGISTROS,
  CAST(sum(CAST(VALOR AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS TOTAL_VALOR
FROM ({_TO_LEDGER_SQL}) GROUP BY ROLLUP (VERSAO, FILIAL)
""")
def q_totals_by_category(spark, sf):
    out = RP.totals_of_accepted(_validated(spark, sf, fx.LOT_BY_ORDER))
    return _totals(out)


@register("totals_by_category_rows", ORACLE["totals_by_category"])
def q_totals_by_category_rows(spark, sf):
    """The same report through the row-level path (gate, ledger projection, rollup)."""
    out = RP.totals_by_category(_accepted_ledger(spark, sf))
    return _totals(out)


@register("ledger_totals", f"""
SELECT VERSAO, FILIAL, CAST(grouping(VERSAO, FILIAL) AS INTEGER) AS NIVEL, count(*) AS REGISTROS,
  CAST(sum(CAST(VALOR AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS TOTAL_VALOR
FROM ({_MERGE_SQL}) GROUP BY ROLLUP (VERSAO, FILIAL)
""")
def q_ledger_totals(spark, sf):
    merged = M.merge_upsert(fx.led(spark, sf), fx.delta(spark, sf), as_of=AS_OF)
    return _totals(RP.totals_by_category(merged))
