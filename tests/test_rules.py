"""Rule tables: one case per row of the reference's sample inputs.

Expected messages are written by hand from the rule catalogue (SURVEY §2.4).
Rows are given as text, the way a CSV read delivers them (empty cell = null).
"""

import datetime as dt

import pytest
from pyspark.sql import types as T

from razonete.operators import validate as V
from razonete.operators.rules import AS_CODED, DOCUMENTED
from razonete.schema import missing_columns_message, normalize_headers

SHEET = ["FILIAL", "DATA", "N CONTA", "N CENTRO CUSTO", "OPERACAO", "VALOR", "DESCRICAO", "TIPO", "VERSAO"]

# one fault per row (the reference's test sheet, rows 2-12)
ONE_FAULT_PER_ROW = [
    ("0101", "01/01/2024", "12345678", "123456789", "OP1234567", "1000.50", "TESTE DE IMPORTACAO", "ORCADO", "2024 - V1"),
    ("0102", "02/01/2024", "87654321", "987654321", "OP7654321", "2500.75", "OUTRO TESTE", "ORCADO", "2024 - V2"),
    ("0103", "03/01/2024", "11223344", "112233445", None, "3750.25", "TESTE SEM OPERACAO", None, "2025 - V2"),
    ("Filial com problema", "04/01/2024", "12345678", "123456789", "OP1234567", "1000.50", "TESTE COM ERRO", "ORCADO", "2024 - V1"),
    ("0104", "05/01/2024", "1234", "123456789", "OP1234567", "1000.50", "TESTE CONTA INVALIDA", "ORCADO", "2024 - V1"),
    ("0105", "05/01/2024", "12345678", "12345", "OP1234567", "1000.50", "TESTE CENTRO CUSTO INVALIDO", "ORCADO", "2024 - V1"),
    ("0106", "data invalida", "12345678", "123456789", "OP1234567", "1000.50", "TESTE DATA INVALIDA", "ORCADO", "2024 - V1"),
    ("0107", "06/01/2024", "12345678", "123456789", "OPERACAO MUITO GRANDE", "1000.50", "TESTE OPERACAO INVALIDA", "ORCADO", "2024 - V1"),
    ("0108", "07/01/2024", "12345678", "123456789", "OP1234567", None, "TESTE VALOR NULO", "ORCADO", "2024 - V1"),
    ("0109", "08/01/2024", "12345678", "123456789", "OP1234567", "1000.50", None, "ORCADO", "2024 - V1"),
    ("0110", "09/01/2024", "12345678", "123456789", "OP1234567", "1000.50", "TESTE VERSAO INVALIDA", "ORCADO", "Versao Invalida"),
]

EXPECTED_AS_CODED = [
    "Linha 5: Filial deve ter 4 dígitos",
    "Linha 8: Data inválida. Use o formato DD/MM/AAAA",
    "Linha 9: Operação não pode ter mais de 10 caracteres",
    "Linha 11: Descrição não pode ser vazia",
]

EXPECTED_DOCUMENTED_EXTRA = [
    "Linha 6: Número da conta deve ter 8 dígitos",
    "Linha 7: Centro de custo deve ter 9 dígitos",
    "Linha 10: Valor não pode ser nulo",
    "Linha 12: Versão deve seguir o padrão 'YYYY - VX'",
]


def lines_of(spark, rows, profile, columns=SHEET):
    from pyspark.sql import functions as F

    schema = T.StructType([T.StructField("_i", T.IntegerType())] + [T.StructField(c, T.StringType()) for c in columns])
    df = normalize_headers(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema))
    df = df.withColumnRenamed("_I", "_i").withColumn("ARQUIVO", F.lit("lote.csv"))
    v = V.apply_rules(df, profile).withColumn(V.LINE_COL, (F.col("_i") + 2).cast("long"))
    out = V.error_lines(v).orderBy(V.LINE_COL, "ORDEM").collect()
    return [r.ERRO for r in out]


def test_header_normaliser():
    from razonete.schema import normalize_header

    assert normalize_header("N CONTA") == "N_CONTA"
    assert normalize_header("n centro  custo") == "N_CENTRO_CUSTO"
    assert normalize_header("VERSÃO") == "VERSAO"
    assert normalize_header(" Descrição ") == "DESCRICAO"


def test_one_fault_per_row_as_coded(spark):
    assert lines_of(spark, ONE_FAULT_PER_ROW, AS_CODED) == EXPECTED_AS_CODED


def test_one_fault_per_row_documented(spark):
    got = lines_of(spark, ONE_FAULT_PER_ROW, DOCUMENTED)
    assert sorted(got) == sorted(EXPECTED_AS_CODED + EXPECTED_DOCUMENTED_EXTRA)


def test_valid_rows_normalised(spark):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in SHEET])
    rows = [
        ("101", "1/1/2024", "12345678", "123456789", "  op  1 ", "1000.5", " conta  de luz ", None, "2024 - V1 "),
    ]
    df = normalize_headers(spark.createDataFrame(rows, schema))
    r = V.apply_rules(df).collect()[0]
    assert r.FILIAL == "0101"
    assert r.DATA == dt.date(2024, 1, 1)
    assert r.OPERACAO == "OP 1"
    assert r.DESCRICAO == "CONTA DE LUZ"
    assert r.TIPO == "ORCADO"
    assert r.VALOR == 1000.5
    assert r.RATEIO == "" and r.ORIGEM == ""       # optional columns absent -> empty
    assert r.VERSAO == "2024 - V1 "                 # as coded: version text untouched
    assert r.N_ERROS == 0


RATEIO_CASES = [("SIM", "SIM", None), ("NÃO", "NAO", None), ("TALVEZ", "TALVEZ", "Rateio deve ser 'SIM' ou 'NÃO'"),
                (None, "", None), ("sim", "SIM", None), ("não", "NAO", None)]


@pytest.mark.parametrize("value,normalised,error", RATEIO_CASES)
def test_rateio(spark, value, normalised, error):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in
                           ["FILIAL", "DATA", "N_CONTA", "N_CENTRO_CUSTO", "VALOR", "DESCRICAO", "VERSAO", "RATEIO"]])
    df = spark.createDataFrame([("0101", "01/01/2025", "12345678", "101100101", "100.0", "x", "2025 - V1", value)], schema)
    r = V.apply_rules(df).collect()[0]
    assert r.RATEIO == normalised
    assert [e.MENSAGEM for e in r.ERROS] == ([error] if error else [])


ORIGEM_CASES = [
    ("SISTEMA FINANCEIRO", "SISTEMA FINANCEIRO", 0),
    ("ESTA É UMA ORIGEM MUITO LONGA QUE EXCEDE OS 60 CARACTERES PERMITIDOS PELO SISTEMA", None, 1),
    ("Sístema Fínanceíro com Açéntos", "SISTEMA FINANCEIRO COM ACENTOS", 0),
    ("\u00dftra\u00dfe   \u00d1and\u00fa\u00a0\u00c4pfel\t", "SSTRASSE \u00d1ANDU \u00c4PFEL", 0),  # ß -> SS; Ñ, Ä keep accents
]


@pytest.mark.parametrize("value,normalised,n_err", ORIGEM_CASES)
def test_origem(spark, value, normalised, n_err):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in
                           ["FILIAL", "DATA", "N_CONTA", "N_CENTRO_CUSTO", "VALOR", "DESCRICAO", "VERSAO", "ORIGEM"]])
    df = spark.createDataFrame([("0101", "01/01/2025", "12345678", "101100101", "100.0", "x", "2025 - V1", value)], schema)
    r = V.apply_rules(df).collect()[0]
    assert r.N_ERROS == n_err
    if normalised is not None:
        assert r.ORIGEM == normalised


def test_missing_mandatory_columns():
    msg = missing_columns_message(["DATA", "TIPO", "VERSAO", "VALOR"])
    assert msg == "Colunas obrigatórias faltando: N_CONTA, N_CENTRO_CUSTO, DESCRICAO, FILIAL"
    assert missing_columns_message(["N_CONTA", "N_CENTRO_CUSTO", "DESCRICAO", "VALOR", "DATA", "VERSAO", "FILIAL"]) is None


EDGE = [
    # (FILIAL, expected normalised FILIAL, filial error?)
    ("7", "0007", False),
    ("12345", "12345", True),
    ("  ", "  ", True),           # not empty before stripping -> digits rule
    ("", "", True),
]


@pytest.mark.parametrize("filial,norm,bad", EDGE)
def test_filial_edges(spark, filial, norm, bad):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in
                           ["FILIAL", "DATA", "N_CONTA", "N_CENTRO_CUSTO", "VALOR", "DESCRICAO", "VERSAO"]])
    df = spark.createDataFrame([(filial, "1/1/2024", "12345678", "101100101", "1", "x", "2025 - V1")], schema)
    r = V.apply_rules(df).collect()[0]
    assert r.FILIAL == norm
    assert (r.N_ERROS > 0) == bad


def test_values_and_dates(spark):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in
                           ["FILIAL", "DATA", "N_CONTA", "N_CENTRO_CUSTO", "VALOR", "DESCRICAO", "VERSAO"]])
    rows = [("0101", d, "1", "1", v, "x", "2025 - v2") for d, v in [
        ("1/1/2024", "1e3"), ("30/02/2024", "1,5"), ("2024-02-01", "nan"), ("01/12/2024", " 2.5 "), ("01/12/2024", "1.000,50")]]
    df = spark.createDataFrame(rows, schema)
    coded = V.apply_rules(df).select("DATA", "VALOR", V.error_text().alias("E")).collect()
    assert coded[0].DATA == dt.date(2024, 1, 1) and coded[0].VALOR == 1000.0
    assert coded[1].DATA is None and coded[1].VALOR is None           # 30/02 invalid; '1,5' not a float
    assert coded[2].DATA is None                                      # ISO is not day-first
    assert coded[3].VALOR == 2.5
    documented = V.apply_rules(df, DOCUMENTED).select("VALOR", "VERSAO").collect()
    assert documented[1].VALOR == 1.5 and documented[4].VALOR == 1000.5
    assert documented[0].VERSAO == "2025 - V2"                        # lower case passes after cleaning
