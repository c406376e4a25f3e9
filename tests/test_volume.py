"""Steps of an import that move less: line numbers, a merge into an empty ledger."""

import datetime as dt
import os
from collections import Counter

from pyspark.sql import functions as F

from razonete.operators import validate as V
from razonete.operators.merge import merge_upsert
from razonete.schema import LEDGER_SCHEMA
from razonete.sources.store import LedgerStore

AS_OF = dt.datetime(2025, 1, 1)
ROW = ("10000001", "100000001", "a <b>", 1.5, dt.date(2024, 1, 2), "2024 - V1", "op", AS_OF, "0101", "", "x")


def ledger(spark, n):
    rows = spark.createDataFrame([ROW], LEDGER_SCHEMA)
    return rows.crossJoin(spark.range(n)).withColumn("N_CONTA", (F.col("id") + 10000000).cast("string"))


def test_line_numbers_move_their_rows_once(spark):
    def name(i):  # a file over several segments, files of one line, lines without a file name
        return "hot.csv" if i % 3 else None if i % 5 == 0 else f"f{i}.csv" if i % 2 else "g.csv"

    data = [(name(i), f"{i * 7919 % 1000:04}", str(i)) for i in range(3000)]
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        out = V.line_numbers_by_content(spark.createDataFrame(data, "ARQUIVO string, A string, B string").repartition(5), "ARQUIVO", ["A", "B"], segments=11)
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert out.columns == ["ARQUIVO", "A", "B", "LINHA"]
    want, seen = {}, Counter()
    for r in sorted(r for r in data if r[0] is not None):
        seen[r[0]] += 1
        want[r] = seen[r[0]] + 1
    assert {(r.ARQUIVO, r.A, r.B): r.LINHA for r in rows} == want


def test_a_merge_into_an_empty_ledger_joins_nothing(spark, tmpdir_path):
    store = LedgerStore(spark, os.path.join(tmpdir_path, "ledger"))
    target = store.read(["2024 - V1"])
    assert target.schema.names == LEDGER_SCHEMA.names and target.count() == 0
    merged = merge_upsert(target, ledger(spark, 5), as_of=AS_OF)
    assert "Join LeftAnti" not in merged._jdf.queryExecution().optimizedPlan().toString()
    assert merged.count() == 5
