"""Merge, gate and mutation properties on the derived fixtures (sf0.001)."""

import datetime as dt

from pyspark.sql import functions as F

from razonete.operators import gate as G
from razonete.operators import merge as M
from razonete.operators import mutate as MU
from razonete.operators import validate as V
from razonete.operators.query import Filters
from razonete.plans import fixtures as fx
from razonete.schema import KEYS, LEDGER_COLUMNS
from tests.conftest import SF001

AS_OF = dt.datetime(2025, 1, 1, 12, 0)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_merge_size_and_idempotence(spark):
    led, delta = fx.led(spark, SF001), fx.delta(spark, SF001)
    once = M.merge_upsert(led, delta, as_of=AS_OF)
    assert once.count() == led.join(delta.select(*KEYS), KEYS, "left_anti").count() + delta.count()
    twice = M.merge_upsert(once, delta, as_of=AS_OF)
    assert same(once, twice)
    assert once.groupBy(*KEYS).count().where("count > 1").count() == 0


def test_dedup_keeps_latest(spark):
    dup = fx.delta_dup(spark, SF001)
    d = M.dedup_latest(dup)
    assert d.count() == dup.select(*KEYS).distinct().count()
    latest = dup.groupBy(*KEYS).agg(F.max("DATA_ATUALIZACAO").alias("DATA_ATUALIZACAO"))
    assert same(d.select(*KEYS, "DATA_ATUALIZACAO"), latest)


def test_merge_actions_add_up(spark):
    led, delta = fx.led(spark, SF001), fx.delta(spark, SF001)
    acts = {r.ACAO: r.n for r in M.merge_actions(led, delta).groupBy("ACAO").agg(F.sum("REGISTROS").alias("n")).collect()}
    assert acts.get("ATUALIZADO", 0) + acts.get("INSERIDO", 0) == delta.count()
    assert acts.get("ATUALIZADO", 0) + acts.get("MANTIDO", 0) == led.count()


def test_gate_partitions_input(spark):
    v = V.apply_rules(fx.raw_by_order(spark, SF001))
    acc, rej = G.accepted_rows(v), G.rejected_rows(v)
    assert acc.count() + rej.count() == v.count()
    assert acc.where(F.col("N_ERROS") > 0).count() == 0
    bad = {r.ARQUIVO for r in G.bad_files(v).collect()}
    assert {r.ARQUIVO for r in rej.select("ARQUIVO").distinct().collect()} == bad


def test_delete_filtered_keeps_null_predicate_rows(spark):
    led = fx.led(spark, SF001)
    f = Filters(rateio="NAO")
    kept = MU.delete_filtered(led, f)
    assert kept.count() == led.where(~F.coalesce(F.col("RATEIO") == "NAO", F.lit(False))).count()
    assert kept.where(F.col("RATEIO").isNull()).count() == led.where(F.col("RATEIO").isNull()).count()
    removed = MU.deleted_count(led, F.col("RATEIO") == "NAO").first().TOTAL
    assert led.count() - kept.count() == removed


def test_delete_requires_a_filter(spark):
    import pytest

    with pytest.raises(ValueError):
        MU.delete_filtered(fx.led(spark, SF001), Filters())


def test_apply_edits_touches_only_edited_rows(spark):
    led, edits = fx.led(spark, SF001), fx.edits(spark, SF001)
    out = MU.apply_edits(led, edits, as_of=AS_OF)
    assert out.count() == led.count()
    changed = out.where(F.col("DATA_ATUALIZACAO") == F.lit(AS_OF).cast("timestamp_ntz"))
    assert changed.count() == edits.count()
    assert changed.where(F.col("FILIAL") != "0199").count() == 0
    assert same(out.join(edits.select(*KEYS), KEYS, "left_anti").select(*LEDGER_COLUMNS),
                led.join(edits.select(*KEYS), KEYS, "left_anti").select(*LEDGER_COLUMNS))
    diff = MU.edit_diff(led, edits)
    assert diff.where(F.col("ALTERACOES").contains("FILIAL: '")).count() == diff.count()


def test_hot_key_dedup_and_merge(spark):
    # one merge key repeated 50,000 times plus ordinary rows: exact result, partial aggregation in the plan
    base = fx.delta(spark, SF001).limit(200).cache()
    hot = base.limit(1)
    copies = hot.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(49999)))) \
        .withColumn("DATA_ATUALIZACAO", F.col("DATA_ATUALIZACAO") + F.expr("make_interval(0,0,0,0,0,0,_k)")) \
        .drop("_k")
    batch = base.unionByName(copies)
    d = M.dedup_latest(batch)
    assert d.count() == base.select(*KEYS).distinct().count()
    top = d.join(hot.select(*KEYS), KEYS).first()
    assert top.DATA_ATUALIZACAO == copies.agg(F.max("DATA_ATUALIZACAO")).first()[0]
    assert "partial_max" in d._jdf.queryExecution().executedPlan().toString()
    merged = M.merge_upsert(fx.led(spark, SF001), batch, as_of=AS_OF)
    assert merged.groupBy(*KEYS).count().where("count > 1").count() == 0


def test_retry_after_orphaned_snapshot(spark, tmpdir_path):
    import os

    from razonete.sources.store import LedgerStore

    store = LedgerStore(spark, os.path.join(tmpdir_path, "ledger"))
    led = fx.led(spark, SF001)
    store.replace_all(led, as_of=AS_OF)
    # a commit that died after writing its folder but before its log row
    orphan = os.path.join(tmpdir_path, "ledger", "snapshots", "s=0000000002-dead")
    led.limit(5).write.partitionBy("VERSAO").parquet(orphan)
    assert same(store.read(), led)                       # invisible
    delta = fx.delta(spark, SF001)
    versions = [r.VERSAO for r in delta.select("VERSAO").distinct().collect()]
    store.commit(M.merge_upsert(store.read(versions), delta, as_of=AS_OF), touched=versions, as_of=AS_OF)
    assert same(store.read(), M.merge_upsert(led, delta, as_of=AS_OF))


def test_text_key_dates_use_flexible_parser(spark):
    led = fx.led(spark, SF001)
    keys = led.select(*KEYS).limit(4).collect()
    fmts = ["%Y-%m-%d", "%d/%m/%Y", "%Y/%m/%d", "%d-%m-%Y"]
    rows = [(k.N_CONTA, k.N_CENTRO_CUSTO, k.DATA.strftime(f), k.VERSAO) for k, f in zip(keys, fmts)]
    text_keys = spark.createDataFrame(rows, "N_CONTA string, N_CENTRO_CUSTO string, DATA string, VERSAO string")
    assert led.count() - MU.delete_keys(led, text_keys).count() == 4
