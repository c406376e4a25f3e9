"""Row images and totals kept from them, against the states they describe (repeats, nulls, changed keys)."""

import datetime as dt
from collections import Counter

import pytest

from razonete.operators import report as RP
from razonete.operators.changes import INSERTED, REMOVED, UPDATED, replay, row_images
from razonete.schema import LEDGER_SCHEMA
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(f.name, f.dataType, True) for f in LEDGER_SCHEMA.fields])
DAY, NOW = dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4)


def row(conta, valor=1.0, filial="0101", rateio=None):
    return (conta, "1", "x", valor, DAY, "2024 - V1", None, NOW, filial, rateio, "A")


BEFORE = [row("same"), row("edit", 2.0), row("gone"), row("twice", 3.0), row("twice", 3.0), row("many", 1.0), row("many", 2.0), row(None, 4.0),
          row("nulls", rateio=None), row("moved", 7.5), row("inf", float("inf"))]
AFTER = [row("same"), row("edit", 2.5, "0102"), row("twice", 3.0), row("many", 5.0), row(None, 4.5), row("nulls", rateio="SIM"),
         row("moved to", 7.5), row("new"), row("new"), row("inf", 1.0, "0103")]


def multiset(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("before,after", [(BEFORE, AFTER), (AFTER, BEFORE), ([], AFTER), (BEFORE, []), (BEFORE, BEFORE), ([], [])])
def test_replay_gives_the_last_state(spark, before, after):
    b, a = spark.createDataFrame(before, SCHEMA), spark.createDataFrame(after, SCHEMA)
    images = row_images(b, a)
    assert multiset(replay(b, images)) == multiset(a)
    if before == after:
        assert images.count() == 0


def test_kinds(spark):
    images = row_images(spark.createDataFrame(BEFORE, SCHEMA), spark.createDataFrame(AFTER, SCHEMA))
    got = Counter((r.TIPO, r.N_CONTA, r.ANTES_VALOR, r.DEPOIS_VALOR, r.VEZES) for r in images.collect())
    assert got == Counter([
        (UPDATED, "edit", 2.0, 2.5, 1), (REMOVED, "gone", 1.0, None, 1), (REMOVED, "twice", 3.0, None, 1), (REMOVED, "many", 1.0, None, 1),
        (REMOVED, "many", 2.0, None, 1), (INSERTED, "many", None, 5.0, 1), (UPDATED, None, 4.0, 4.5, 1), (UPDATED, "nulls", 1.0, 1.0, 1),
        (REMOVED, "moved", 7.5, None, 1), (INSERTED, "moved to", None, 7.5, 1), (INSERTED, "new", None, 1.0, 2), (UPDATED, "inf", float("inf"), 1.0, 1)])


def test_replay_on_another_state_fails(spark):
    b, a = spark.createDataFrame(BEFORE, SCHEMA), spark.createDataFrame([], SCHEMA)
    with pytest.raises(Exception, match="another state"):
        replay(a, row_images(b, a)).collect()


@pytest.mark.parametrize("before,after", [(BEFORE, AFTER), (AFTER, BEFORE)])
def test_kept_totals_equal_recomputed_ones(spark, before, after):
    b, a = spark.createDataFrame(before, SCHEMA), spark.createDataFrame(after, SCHEMA)
    kept = RP.totals_of_leaves(RP.updated_leaves(RP.category_leaves(b), RP.changed_leaves(row_images(b, a))))
    assert multiset(kept) == multiset(RP.totals_by_category(a).select(*kept.columns))


def test_an_edit_compares_and_joins_only_once(spark, tmpdir_path, monkeypatch):
    """The change table of an edit reads the rows it found, not two whole states; it replays, also with repeats and moved keys."""
    from razonete.operators.audit import AuditContext
    from razonete.plans import maintenance
    from razonete.schema import EDITABLE, KEYS
    from razonete.sources.store import AuditLog, LedgerStore

    store, audit = LedgerStore(spark, f"{tmpdir_path}/ledger"), AuditLog(spark, f"{tmpdir_path}/audit")
    rows = [row("edit", 2.0), row("twice", 3.0), row("twice", 3.0), row("moved", 7.5), row("there", 7.5), row(None, 4.0), *[row(f"k{i}") for i in range(50)]]
    store.replace_all(spark.createDataFrame(rows, SCHEMA))
    first = store.read()
    edits = first.where("N_CONTA in ('edit', 'twice', 'moved')").distinct().selectExpr(
        *KEYS, *[f"{'VALOR + 1' if c == 'VALOR' else 'if(N_CONTA = \"moved\", \"to\", N_CONTA)' if c == 'N_CONTA' else c} AS NOVO_{c}" for c in EDITABLE])
    seen = []
    plain = maintenance.row_images
    monkeypatch.setattr(maintenance, "row_images", lambda b, a: seen.append((b.count(), a.count())) or plain(b, a))
    assert maintenance.edit_records(store, audit, edits, AuditContext(as_of=NOW)) == 4
    assert seen == [(4, 4)]
    assert multiset(replay(first, audit.images())) == multiset(store.read())
    assert Counter(r.N_CONTA for r in store.read().collect()) == Counter(["to" if r[0] == "moved" else r[0] for r in rows])
    collide = first.where("N_CONTA = 'edit'").selectExpr(*KEYS, *[f"{chr(39) + 'there' + chr(39) if c == 'N_CONTA' else c} AS NOVO_{c}" for c in EDITABLE])
    with pytest.raises(maintenance.KeyCollision):
        maintenance.edit_records(store, audit, collide, AuditContext(as_of=NOW))
