"""Snapshot ledger store, the import plan and the landing-folder stream."""

import datetime as dt
import os

from pyspark.sql import functions as F

from razonete.operators import merge as M
from razonete.operators.audit import AuditContext
from razonete.plans import fixtures as fx
from razonete.plans.importer import import_batch
from razonete.schema import RAW_COLUMNS
from razonete.sources.store import AuditLog, LedgerStore
from razonete.streaming.ingest import run_ingest
from tests.conftest import SF001

AS_OF = dt.datetime(2025, 1, 1, 12, 0)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_store_commit_touches_only_batch_versions(spark, tmpdir_path):
    store = LedgerStore(spark, os.path.join(tmpdir_path, "ledger"))
    led, delta = fx.led(spark, SF001), fx.delta(spark, SF001)
    s1 = store.replace_all(led, as_of=AS_OF)
    assert same(store.read(), led)
    before = store.live()
    versions = [r.VERSAO for r in delta.select("VERSAO").distinct().collect()]
    merged = M.merge_upsert(store.read(versions), delta, as_of=AS_OF)
    s2 = store.commit(merged, touched=versions, as_of=AS_OF)
    assert s2 == s1 + 1
    after = store.live()
    untouched = set(before) - set(versions)
    assert all(after[v] == before[v] for v in untouched)          # carried by reference
    assert same(store.read(), M.merge_upsert(led, delta, as_of=AS_OF))
    # pruning: reading one version plans a partition filter
    plan = store.read([versions[0]])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_import_batch_end_to_end(spark, tmpdir_path):
    store = LedgerStore(spark, os.path.join(tmpdir_path, "ledger"))
    audit = AuditLog(spark, os.path.join(tmpdir_path, "audit"))
    ctx = AuditContext(as_of=AS_OF)
    res = import_batch(fx.raw_by_order(spark, SF001), store, audit, ctx)
    ledger = store.read()
    assert ledger.count() == res.accepted.count() > 0
    assert ledger.where(F.length("N_CENTRO_CUSTO") != 9).count() == 0
    assert res.errors.count() > 0
    a = audit.read()
    assert a.agg(F.sum("TOTAL_REGISTROS")).first()[0] == ledger.count()
    assert {r.STATUS for r in a.collect()} == {"IMPORTACAO_COMPLETA"}


def test_stream_restart_adds_nothing(spark, tmpdir_path):
    raw = fx.raw_by_order(spark, SF001).select(*RAW_COLUMNS)
    landing = os.path.join(tmpdir_path, "landing")
    raw.write.option("header", True).option("maxRecordsPerFile", 200).csv(landing)
    args = (spark, landing, os.path.join(tmpdir_path, "ledger"), os.path.join(tmpdir_path, "audit"),
            os.path.join(tmpdir_path, "ckpt"))
    store, audit = run_ingest(*args, as_of=AS_OF, max_files_per_trigger=3)
    n1, s1 = store.read().count(), store.snapshot_id()
    store2, _ = run_ingest(*args, as_of=AS_OF, max_files_per_trigger=3)
    assert store2.read().count() == n1 and store2.snapshot_id() == s1


def test_edit_and_delete_paths(spark, tmpdir_path):
    from razonete.operators.query import Filters
    from razonete.plans.maintenance import delete_records, edit_records

    store = LedgerStore(spark, os.path.join(tmpdir_path, "ledger"))
    audit = AuditLog(spark, os.path.join(tmpdir_path, "audit"))
    ctx = AuditContext(as_of=AS_OF)
    led, edits = fx.led(spark, SF001), fx.edits(spark, SF001)
    store.replace_all(led, as_of=AS_OF)
    n_led = led.count()
    assert edit_records(store, audit, edits, ctx) == edits.count()
    assert store.read().where(F.col("FILIAL") == "0199").count() == edits.count()
    f = Filters(data_inicio="1997-01-01", data_fim="1997-12-31", rateio="NAO")
    expect = store.read().where("DATA >= DATE'1997-01-01' AND DATA <= DATE'1997-12-31' AND RATEIO = 'NAO'").count()
    assert delete_records(store, audit, ctx, filters=f) == expect > 0
    assert store.read().count() == n_led - expect
    assert delete_records(store, audit, ctx, filters=Filters(versao="1900 - V1")) == 0   # no match: no-op
    v = store.read().select("VERSAO").first().VERSAO
    nv = store.read().where(F.col("VERSAO") == v).count()
    assert delete_records(store, audit, ctx, versao=v) == nv
    assert store.read().where(F.col("VERSAO") == v).count() == 0
    rows = {r.STATUS: r for r in audit.read().collect()}
    assert set(rows) == {"EDITADO", "DELETADO"}
    totals = audit.read().where("STATUS = 'DELETADO'").agg(F.sum("TOTAL_REGISTROS")).first()[0]
    assert totals == expect + nv


def test_cost_centre_gate_follows_profile(spark, tmpdir_path):
    from pyspark.sql import types as T

    cols = ["FILIAL", "DATA", "N_CONTA", "N_CENTRO_CUSTO", "VALOR", "DESCRICAO", "VERSAO", "ARQUIVO"]
    rows = [("0101", "01/01/2024", "12345678", None, "10.00", "x", "2024 - V1", "a.csv"),   # account starts with 1
            ("0101", "02/01/2024", "22345678", "123456789", "20.00", "y", "2024 - V1", "b.csv")]
    raw = spark.createDataFrame(rows, T.StructType([T.StructField(c, T.StringType()) for c in cols]))
    ctx = AuditContext(as_of=AS_OF)
    for profile, expect in (("as_coded", {"b.csv"}), ("documented", {"a.csv", "b.csv"})):
        store = LedgerStore(spark, os.path.join(tmpdir_path, profile, "ledger"))
        res = import_batch(raw, store, AuditLog(spark, os.path.join(tmpdir_path, profile, "audit")), ctx,
                           profile=profile)
        assert {r.ARQUIVO for r in res.accepted.select("ARQUIVO").collect()} == expect


def test_stream_query_lands_all_of_raw(spark, tmpdir_path, monkeypatch):
    """Every raw line reaches the landing folder; the stream's own gate rejects the faulty lots."""
    from razonete.plans import io_queries as IO

    monkeypatch.setattr(IO, "scratch_path", lambda _, name: os.path.join(tmpdir_path, name))
    got = IO.q_stream_ingest(spark, SF001)
    landed = spark.read.option("header", True).csv(os.path.join(tmpdir_path, "stream", "landing"))
    raw = fx.raw_by_order(spark, SF001)
    assert same(landed.select(*RAW_COLUMNS), raw.select(*RAW_COLUMNS))
    store = LedgerStore(spark, os.path.join(tmpdir_path, "one-batch"))
    import_batch(raw, store, AuditLog(spark, os.path.join(tmpdir_path, "one-audit")), AuditContext(as_of=IO.AS_OF))
    assert 0 < got.count() < raw.count() and same(got, store.read())


def test_stream_gates_lots_inside_a_file(spark, tmpdir_path):
    good = fx.raw_by_order(spark, SF001).where("FILIAL = '0101' OR FILIAL = '101'").where(
        "VALOR IS NOT NULL AND VALOR <> 'abc' AND length(N_CENTRO_CUSTO) = 9 AND DATA <> 'data invalida'"
        " AND DESCRICAO IS NOT NULL AND length(OPERACAO) < 9 AND RATEIO <> 'TALVEZ' AND length(ORIGEM) < 60").limit(4)
    rows = [{c: r[c] for c in RAW_COLUMNS} for r in good.collect()]
    rows[1]["DATA"] = "data invalida"
    for r, lot in zip(rows, ("a", "b", "c", None)):
        r["Lote"] = lot
    cols = [*RAW_COLUMNS, "Lote"]
    landing = os.path.join(tmpdir_path, "landing")
    df = spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], ", ".join(f"{c} string" for c in cols))
    df.coalesce(1).write.option("header", True).csv(landing)
    store, audit = run_ingest(spark, landing, os.path.join(tmpdir_path, "ledger"), os.path.join(tmpdir_path, "audit"),
                              os.path.join(tmpdir_path, "ckpt"), as_of=AS_OF, lot_header="Lote")
    assert sorted(r.N_CENTRO_CUSTO for r in store.read().collect()) == sorted(r["N_CENTRO_CUSTO"] for k, r in enumerate(rows) if k != 1)
    assert audit.read().count() == 3
