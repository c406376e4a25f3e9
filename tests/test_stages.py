"""Steps that read their input several times read it as written rows, and micro-batches do not grow in number."""

import math

from pyspark.sql import functions as F

from razonete.llm.common import map_batches
from razonete.plans import io_queries
from razonete.schema import LEDGER_SCHEMA
from razonete.sources import files, store
from razonete.streaming import ingest


def test_a_commit_arranges_written_rows(spark, tmpdir_path, monkeypatch):
    seen = []
    write = store.write_clustered
    monkeypatch.setattr(store, "write_clustered", lambda rows, *a: (seen.append(rows), write(rows, *a)))
    rows = spark.range(20).select(*[(F.lit("2024 - V1") if f.name == "VERSAO" else F.col("id").cast("string")).try_cast(f.dataType).alias(f.name)
                                    for f in LEDGER_SCHEMA.fields if f.name != "VALOR"], F.lit(1.0).alias("VALOR"))
    merged = rows.groupBy(*[c for c in rows.columns if c != "VALOR"]).agg(F.sum("VALOR").alias("VALOR"))
    ledger = store.LedgerStore(spark, tmpdir_path)
    ledger.commit(merged, touched=["2024 - V1"])
    assert "Aggregate" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert ledger.read().count() == 20


def test_headers_and_cells_read_written_records(spark, tmpdir_path):
    with open(f"{tmpdir_path}/a.csv", "w") as f:
        f.write('FILIAL,DESCRICAO\n1,"a\nb"\n\n2,c\n')
    rows = files.read_csv_files(spark, tmpdir_path)
    assert {p.split("/razonete/")[1].split("-")[0] for p in rows.inputFiles()} == {"records", "headers"}
    assert sorted((r.FILIAL, r.DESCRICAO, r.LINHA) for r in rows.collect()) == [("1", "a\nb", 2), ("2", "c", 5)]


def test_stream_ingest_has_two_micro_batches_at_any_partition_count(spark, monkeypatch):
    found = []

    def run(spark, landing, *a, max_files_per_trigger, **k):
        found.append(math.ceil(len(spark.read.text(landing).inputFiles()) / max_files_per_trigger))
        return store.LedgerStore(spark, f"{landing}-ledger"), None

    monkeypatch.setattr(ingest, "run_ingest", run)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (8, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            io_queries.q_stream_ingest(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == [2, 2]


def test_slices_of_a_given_size(spark):
    import pyarrow as pa

    docs = spark.range(40).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text"))
    n = map_batches(docs, lambda b: pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"]), "n bigint", 1000)
    assert [r.n for r in n.collect()] == [10] * 4
