"""XML/CSV sinks, file-name helpers, audit texts and the expectation suite."""

import datetime as dt
import glob
import os
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from razonete.operators import audit as A
from razonete.operators import expect as E
from razonete.operators import mutate as MU
from razonete.operators.query import Filters
from razonete.plans import fixtures as fx
from razonete.sources import files
from tests.conftest import SF001

CTX = A.AuditContext(as_of=dt.datetime(2025, 1, 2, 3, 4, 5), usuario="u", sistema_operacional="Linux", versao_sistema="1")


def test_xml_sink_round_trip(spark, tmpdir_path):
    led = fx.led(spark, SF001).limit(50)
    out = os.path.join(tmpdir_path, "xml")
    files.write_xml(files.ledger_text(led), out, origin="lote_1.csv", processed_at="2025-01-02 03:04:05")
    docs = glob.glob(os.path.join(out, "registros", "part-*"))
    n = 0
    for d in docs:
        root = ET.parse(d).getroot()
        assert root.tag == "Registros"
        for reg in root:
            assert reg.tag == "Registro" and reg.find("N_CONTA") is not None
            n += 1
    assert n == 50
    head = [ET.parse(d).getroot() for d in glob.glob(os.path.join(out, "_metadados", "part-*"))]
    meta = [m for h in head for m in h]
    assert len(meta) == 1 and meta[0].find("TotalRegistros").text == "50"
    assert meta[0].find("ArquivoOrigem").text == "lote_1.csv"


def test_file_name_helpers(spark):
    df = spark.createDataFrame([("/a/b/orcado.2025.xlsx",), ("x.CSV",), ("notes.txt",), ("semext",)], "p string")
    got = df.select(files.base_name(F.col("p")).alias("b"), files.processed_name(F.col("p")).alias("n"),
                    files.allowed_extension(F.col("p")).alias("ok")).collect()
    assert [r.b for r in got] == ["orcado.2025", "x", "notes", "semext"]
    assert got[0].n == "processado_orcado.2025"
    assert [r.ok for r in got] == [True, True, False, False]


def test_audit_texts(spark):
    led, edits = fx.led(spark, SF001), fx.edits(spark, SF001)
    row = A.audit_delete_filtered(led, Filters(versao="1996 - V1", rateio="SIM"), CTX).first()
    assert row.ARQUIVO_ORIGEM == "DELETADO: Filtros aplicados"
    assert row.DETALHES == ("Registros deletados com filtros: Filial=, Conta=, Centro Custo=, Data Início=, "
                            "Data Fim=, Versão=1996 - V1, Operação=, Rateio=SIM, Origem=")
    assert row.TOTAL_REGISTROS == led.where("VERSAO = '1996 - V1' AND RATEIO = 'SIM'").count()
    e = A.audit_edit(MU.edit_diff(led, edits), CTX).first()
    assert e.STATUS == "EDITADO" and e.DETALHES.startswith("Alterações: FILIAL: '")
    assert e.ARQUIVO_ORIGEM.startswith("EDITADO: ") and e.ARQUIVO_ORIGEM.count("/") == 3
    f = A.audit_delete_filial(led, "0107", CTX).first()
    assert (f.ARQUIVO_ORIGEM, f.DETALHES) == ("DELETADO: Filial 0107", "Registros deletados para filial 0107")
    assert f.TOTAL_REGISTROS == led.where("FILIAL = '0107'").count()


def test_expectation_suite_reports_failures(spark):
    df = spark.createDataFrame([(1, "ok item", 10.0, dt.datetime(2024, 1, 1)),
                                (2, "bad*text", -1.0, None),
                                (None, "ok", None, dt.datetime(2024, 1, 2))],
                               "codigo bigint, descricao string, valor double, data timestamp")
    res = {(r.EXPECTATIVA, r.COLUNA): r for r in E.run_suite(df, E.suite_from_config()).collect()}
    assert res[(E.NOT_NULL, "codigo")].FALHAS == 1
    assert res[(E.NOT_NULL, "data")].FALHAS == 1
    assert res[(E.GREATER, "valor")].FALHAS == 1
    assert res[(E.REGEX, "descricao")].FALHAS == 1
    assert res[(E.EXISTS, "codigo")].SUCESSO and res[(E.OF_TYPE, "valor")].SUCESSO
    overall = E.suite_success(E.run_suite(df, E.suite_from_config())).first()
    assert overall.SUCESSO is False and len(overall.FALHAS) == 5  # valor is also null once
    missing = E.run_suite(df.drop("valor"), E.suite_from_config())
    assert missing.where("COLUNA = 'valor' AND NOT SUCESSO").count() == 4


def test_edit_set_with_repeated_keys_does_not_multiply_rows(spark):
    led, edits = fx.led(spark, SF001), fx.edits(spark, SF001)
    doubled = edits.unionByName(edits.withColumn("NOVO_VALOR", F.col("NOVO_VALOR") + 1))
    out = MU.apply_edits(led, doubled, as_of=dt.datetime(2025, 1, 1))
    assert out.count() == led.count()
