"""Lots over several files, triggers and runs (T1), and the outputs of an import's lots."""

import datetime as dt
import os

from razonete.operators.audit import AuditContext
from razonete.operators.outputs import read_outputs
from razonete.plans.importer import import_batch
from razonete.sources.files import read_csv_files
from razonete.sources.store import AuditLog, LedgerStore
from razonete.streaming.ingest import run_lot_ingest

AS_OF = dt.datetime(2025, 1, 1)
HEAD = "FILIAL,DATA,N CONTA,N CENTRO CUSTO,VALOR,DESCRICAO,VERSAO"


def row(k, filial="0101", text="linha"):
    return f"{filial},01/02/2024,{10000000 + k},{100000000 + k},{k}.5,{text},2024 - V1"


def put(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as fh:
        fh.write("\n".join(lines) + "\n")


def test_lots_over_triggers_and_restarts(spark, tmpdir_path):
    landing, at = os.path.join(tmpdir_path, "in"), lambda n: os.path.join(tmpdir_path, n)
    run = lambda: run_lot_ingest(spark, landing, at("ledger"), at("audit"), at("state"), at("ckpt"), AS_OF, "LOTE", max_files_per_trigger=1)
    put(landing, "a.csv", [f"{HEAD},LOTE", row(1) + ",A", row(2) + ",B", row(3) + ",C", row(4) + ",A"])
    store, _, state = run()
    assert store.latest_snapshot() is None if hasattr(store, "latest_snapshot") else store.read().count() == 0
    put(landing, "b.csv", [f"LOTE,{HEAD}", "A," + row(5, text='"duas\nlinhas"'), "B," + row(6, filial="Filial X"), "C," + row(7)])
    put(landing, "c.manifesto.csv", ["LOTE,LINHAS", "A,3", "B,2"])
    store, audit, state = run()
    got = lambda: sorted(r.N_CONTA for r in store.read().collect())
    assert got() == ["10000001", "10000004", "10000005"]           # A whole, B rejected whole, C waits
    assert [(r.LOTE, r.RECEBIDAS, r.ANUNCIADAS) for r in state.open_lots(2).collect()] == [("C", 2, None)]
    n = audit.read().count() if hasattr(audit, "read") else None
    run()
    assert got() == ["10000001", "10000004", "10000005"]           # a restart adds nothing
    assert n is None or audit.read().count() == n
    put(landing, "d.manifesto.csv", ["LOTE,LINHAS", "C,2"])
    run()
    assert got() == ["10000001", "10000003", "10000004", "10000005", "10000007"]


def test_outputs_of_lots(spark, tmpdir_path):
    landing, out = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    put(landing, "bom.csv", [HEAD, "", row(1), row(2, text='"a ""b"" <c>\nd & e"')])
    put(landing, "ruim.csv", [HEAD, row(3), "", row(4, filial="x")])
    put(landing, "curto.csv", [HEAD, row(5).replace("100000005", "12345")])
    put(landing, "sem.csv", ["FILIAL,DATA", "0101,01/02/2024"])
    store = LedgerStore(spark, os.path.join(tmpdir_path, "ledger"))
    res = import_batch(read_csv_files(spark, landing), store, AuditLog(spark, os.path.join(tmpdir_path, "audit")), AuditContext(as_of=AS_OF), outputs=out)
    csv, xml, heads, rejected = read_outputs(spark, out)
    want = [("processado_bom", "10000001", "LINHA", "1.5"), ("processado_bom", "10000002", 'A "B" <C> D & E', "2.5")]
    for df in (csv, xml):
        assert sorted((r.SAIDA, r.N_CONTA, r.DESCRICAO, r.VALOR) for r in df.collect()) == want
    assert [(r.ArquivoOrigem, r.TotalRegistros, r.DataProcessamento) for r in heads.collect()] == [("bom.csv", "2", "2025-01-01 00:00:00")]
    assert sorted((r.SAIDA, r.LINHA, r.ERROS or "") for r in rejected.where("SAIDA <> 'sem.csv'").collect()) == [
        ("curto.csv", "2", ""), ("ruim.csv", "2", ""), ("ruim.csv", "4", "Filial deve ter 4 dígitos")]
    assert sorted((r.ARQUIVO, r.RESULTADO, r.MOTIVO, r.TOTAL_LINHAS, r.LINHAS_NO_RAZAO) for r in res.outcomes.collect()) == [
        ("bom.csv", "ACEITO", None, 2, 2), ("curto.csv", "REJEITADO", "CENTRO_CUSTO", 1, 0), ("ruim.csv", "REJEITADO", "ERROS", 2, 0),
        ("sem.csv", "REJEITADO", "COLUNAS", 1, 0)]
    assert sorted(r.ERRO for r in res.errors.where("CAMPO = 'FILIAL'").collect()) == ["Linha 4: Filial deve ter 4 dígitos"]


def test_lots_are_dealt_by_the_source_columns(spark):
    """The landed lots move as the source's columns, before they become text; a lot stays whole and no line is lost."""
    from collections import Counter

    from pyspark.sql import functions as F

    from razonete.plans import fixtures as fx

    plain, dealt = fx.raw_by_order(spark, "/root/testdata/sf0.001"), fx.raw_by_order(spark, "/root/testdata/sf0.001", 5)
    assert "hashpartitioning(l_orderkey" in dealt._jdf.queryExecution().executedPlan().toString()
    placed = dealt.withColumn("_p", F.spark_partition_id())
    assert placed.groupBy("ARQUIVO").agg(F.count_distinct("_p").alias("n")).where("n > 1").isEmpty()
    assert 1 < placed.select("_p").distinct().count() <= 5
    assert Counter(map(tuple, dealt.collect())) == Counter(map(tuple, plain.collect()))
