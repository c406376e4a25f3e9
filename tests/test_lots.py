"""Lots by full path, the split of a hot file, and line numbers that no optimiser setting changes."""

import datetime as dt
import re

from pyspark.sql import functions as F

from razonete.operators import gate as G
from razonete.operators import validate as V
from razonete.operators.audit import AuditContext
from razonete.plans.importer import import_batch
from razonete.sources.files import read_csv_files
from razonete.sources.store import AuditLog, LedgerStore

HEADER = "FILIAL,DATA,N_CONTA,N_CENTRO_CUSTO,OPERACAO,VALOR,DESCRICAO,TIPO,VERSAO,RATEIO,ORIGEM"
GOOD = "0101,02/01/2025,12345678,123456789,op,10.5,linha,normal,2025 - V1,SIM,SISTEMA"


def test_files_of_one_name_are_two_lots(spark, tmp_path):
    for folder, row in (("x", GOOD), ("y", GOOD.replace("10.5", "abc").replace("12345678,", "22345678,"))):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "a.csv").write_text(f"{HEADER}\n{row}\n")
    raw = read_csv_files(spark, [str(tmp_path / "in" / f) for f in ("x", "y")])
    store = LedgerStore(spark, str(tmp_path / "ledger"))
    audit = AuditLog(spark, str(tmp_path / "audit"))
    res = import_batch(raw, store, audit, AuditContext(as_of=dt.datetime(2025, 1, 15)))
    assert [r.N_CONTA for r in store.read().collect()] == ["12345678"]
    assert [r._file.split("/")[-2:] for r in res.rejected_files.collect()] == [["y", "a.csv"]]
    assert [r.TOTAL_REGISTROS for r in audit.read().collect()] == [1]
    assert {r.ARQUIVO for r in res.errors.collect()} == {"a.csv"}


def test_hot_file_is_split_in_the_gate_join(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 40_000, 1, 8).select(
            F.when(F.col("id") % 5 < 3, F.lit("hot.csv")).otherwise(F.concat(F.lit("f"), F.col("id") % 97)).alias("ARQUIVO"),
            F.sha2(F.col("id").cast("string"), 256).alias("x"), (F.col("id") == 1).cast("int").alias(V.N_ERR_COL))
        kept, gone = G.split_files(rows)
        assert kept.count() + gone.count() == 40_000
        kept.collect()
        text = kept._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"skew=true", text), text[:3000]
        names = {r.ARQUIVO for r in gone.select("ARQUIVO").distinct().collect()}
        assert not names & {r.ARQUIVO for r in kept.select("ARQUIVO").distinct().collect()}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_line_numbers_do_not_hang_on_exchange_reuse(spark):
    df = spark.range(0, 5000, 1, 7).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot.csv")).otherwise(F.concat(F.lit("f"), F.col("id") % 11)).alias("ARQUIVO"),
        (F.col("id") * 7919 % 1000).cast("string").alias("A"), F.col("id").cast("string").alias("B"))
    got = []
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        got.append({(r.ARQUIVO, r.A, r.B, r.LINHA) for r in V.line_numbers_by_content(df, "ARQUIVO", ["A", "B"], segments=9).collect()})
    spark.conf.set("spark.sql.exchange.reuse", "true")
    assert len(got[0]) == 5000 and got[0] == got[1]
