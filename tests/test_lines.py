"""Source line numbers (S5) against brute force, including a hot file."""

import csv
import glob
import os

from pyspark.sql import functions as F

from razonete.operators import validate as V
from razonete.sources import files


def test_physical_lines_match_csv_files(spark, tmpdir_path):
    # many rows in few files, split into small blocks so a file spans many tasks
    rows = [(f"{i % 7:04d}" if i % 13 else "bad", f"{1 + i % 28:02d}/01/2024", str(10000000 + i), str(100000000 + i),
             "op", str(i * 1.5), f"linha {i}", "x", "2024 - V1", "SIM", "ERP") for i in range(3000)]
    cols = ["FILIAL", "DATA", "N_CONTA", "N_CENTRO_CUSTO", "OPERACAO", "VALOR", "DESCRICAO", "TIPO", "VERSAO",
            "RATEIO", "ORIGEM"]
    df = spark.createDataFrame(rows, cols).repartition(3)
    path = os.path.join(tmpdir_path, "landing")
    files.write_csv(df, path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        batch = files.read_csv_batch(spark, path)
        assert batch.rdd.getNumPartitions() > 3  # files really are split
        numbered = V.line_numbers_by_position(V.apply_rules(batch))
        got = {(r.ARQUIVO, r.LINHA): r.DESCRICAO for r in numbered.select("ARQUIVO", "LINHA", "DESCRICAO").collect()}
        errs = V.error_lines(numbered).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {}
    for f in glob.glob(os.path.join(path, "*.csv")):
        with open(f, newline="", encoding="utf-8") as fh:
            for i, rec in enumerate(csv.DictReader(fh)):
                want[(os.path.basename(f), i + 2)] = rec["DESCRICAO"].upper()
    assert got == want
    assert all(e.ERRO == f"Linha {e.LINHA}: Filial deve ter 4 dígitos" for e in errs)
    assert len(errs) == sum(1 for i in range(3000) if i % 13 == 0)


def test_content_lines_with_hot_file(spark):
    # one file holds most rows; numbering must still be 2..n+1 in content order
    rows = [("hot.csv" if i % 10 else f"f{i % 3}.csv", f"{(i * 7919) % 5000:05d}", str(i)) for i in range(4000)]
    df = spark.createDataFrame(rows, ["ARQUIVO", "A", "B"])
    out = V.line_numbers_by_content(df, "ARQUIVO", ["A", "B"], segments=16).collect()
    by_file = {}
    for r in out:
        by_file.setdefault(r.ARQUIVO, []).append((r.A, r.B, r.LINHA))
    for f, items in by_file.items():
        expect = sorted((a, b) for a, b, _ in items)
        got = [(a, b) for a, b, _ in sorted(items, key=lambda t: t[2])]
        assert got == expect
        assert sorted(x[2] for x in items) == list(range(2, len(items) + 2))


def test_segments_split_the_hot_file(spark):
    rows = [("hot.csv", f"{i:06d}") for i in range(2000)]
    df = spark.createDataFrame(rows, ["ARQUIVO", "A"]).repartitionByRange(8, "ARQUIVO", "A")
    sizes = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 2000 / 2  # no single task holds the file
