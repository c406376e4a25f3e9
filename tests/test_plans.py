"""Plan shape: no Python in any registered query, top-k without a full sort, codegen."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF001

SKIP_SIDE_EFFECTS = {"stream_ingest", "scan_csv", "error_lines_csv", "table_append", "schema_evolve",
                     "ledger_scan", "ledger_merge_commit"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contract_keys():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 70
    missing = set(q) - set(o) - set(entry.LLM)  # the optional subpackage has its own tests
    assert missing <= {"error_lines_csv"}


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SKIP_SIDE_EFFECTS))
def test_no_python_in_plans(spark, name):
    p = plan(entry.queries()[name](spark, SF001))
    assert "PythonUDF" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_latest_is_top_k(spark):
    p = plan(entry.queries()["latest_100"](spark, SF001))
    assert "TakeOrderedAndProject" in p


def test_rules_in_whole_stage_codegen(spark):
    df = entry.queries()["transform_rows"](spark, SF001)
    txt = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in txt  # one narrow pass, whatever the number of input splits
    rule_stage = [ln for ln in txt.splitlines() if "N_ERROS" in ln and "Project" in ln]
    assert rule_stage and all("*(" in ln for ln in rule_stage)  # inside whole-stage codegen
    assert "lambdafunction" not in txt


def test_ledger_filter_pushdown(tmpdir_path, spark):
    import os

    from razonete.operators.query import Filters, ledger_filter
    from razonete.plans import fixtures as fx

    path = os.path.join(tmpdir_path, "led")
    fx.led(spark, SF001).write.partitionBy("VERSAO").parquet(path)
    df = ledger_filter(spark.read.parquet(path), Filters(versao="1996 - V2", filial="0107", data_inicio="1996-01-01"))
    p = plan(df)
    assert "PartitionFilters: [isnotnull(VERSAO" in p
    assert "PushedFilters" in p and "FILIAL" in p


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["VERSAO", "FILIAL", "NIVEL", "REGISTROS", "TOTAL_VALOR"]
