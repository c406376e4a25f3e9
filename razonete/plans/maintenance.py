"""Edit and delete paths (lifecycle L3) committed to the ledger store.

Each operation reads only the versions it can touch, computes the new rows of
those versions with the set-based operators (M3-M7), commits them as a new
snapshot (untouched versions are carried by reference) and appends the audit
rows with the true counts. A request that matches nothing is a no-op, as in
the reference's delete-by-filters; the audit is appended after the commit,
the same order the reference uses. Snapshots are immutable, so the audit is
computed lazily from the pre-change snapshot even after the commit: nothing
but per-version counts reaches the driver. Every commit also writes its change
table (row images before and after, ``AuditLog.images``): a delete's from its two
snapshots, an edit's from the rows it found, as all others stay as they were.
An edit set meets the ledger in one join, written once: the new state, the counts,
the audit and the change table read that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import mutate as MU
from ..operators.changes import row_images
from ..operators.query import Filters, predicate
from ..schema import KEYS
from ..sources.store import COMPACT, AuditLog, LedgerStore, stage


class KeyCollision(ValueError):
    """An edit would give a record the key of another existing record."""


def _versions(df: DataFrame) -> list[str]:
    # one row per version: metadata-sized
    return [r.VERSAO for r in df.select("VERSAO").distinct().collect()]


def edit_records(store: LedgerStore, audit_log: AuditLog, edits: DataFrame, ctx: A.AuditContext) -> int:
    """M1-M3 + A2: apply an edit set; returns the number of records found and updated."""
    edits = stage(MU.one_edit_per_key(edits), "edits")  # one set for the collision check, the update and the audit
    versions = _versions(edits)
    current = store.read(versions)
    joined = stage(MU.with_edits(current, edits), "with-edits", **COMPACT)
    hits = joined.where(MU.HIT)
    found = hits.count()
    # an edit that keeps its key collides with nothing
    if not MU.rekeyed(hits).isEmpty() and MU.edit_key_collisions(current, edits).limit(1).count() > 0:
        raise KeyCollision("an edit would duplicate the key of an existing record")
    if found == 0:
        return 0
    snapshot = store.commit(MU.edited(joined, ctx.as_of), touched=versions, as_of=ctx.as_of, written=True)
    audit_log.append(A.audit_edit(MU.changes_of(hits), ctx))
    audit_log.put_images(row_images(hits, MU.edited(hits, ctx.as_of)), snapshot)
    return found


def delete_records(
    store: LedgerStore,
    audit_log: AuditLog,
    ctx: A.AuditContext,
    keys: DataFrame | None = None,
    versao: str | None = None,
    filial: str | None = None,
    filters: Filters | None = None,
) -> int:
    """M4-M7 + A3: delete by key set, version, branch or filters (exactly one); returns the count."""
    chosen = [x is not None for x in (keys, versao, filial, filters)]
    if sum(chosen) != 1:
        raise ValueError("give exactly one of keys, versao, filial, filters")
    if versao is not None:
        current = store.read([versao])
        n = current.count()
        if n == 0:
            return 0
        snapshot = store.commit(current.limit(0), touched=[], removed=[versao], as_of=ctx.as_of)
        audit_log.append(A.audit_delete_version(current, versao, ctx))
        audit_log.put_images(row_images(current, store.read([versao])), snapshot)
        return n
    if keys is not None:
        keys = MU.typed_keys(keys)
        cond_rows = store.read(_versions(keys))
        hit = cond_rows.join(keys.select(*KEYS).distinct(), KEYS, "left_semi")
        new_rows = lambda cur: MU.delete_keys(cur, keys)
        audit_rows = lambda cur: A.audit_delete_keys(cur, keys, ctx)
    elif filial is not None:
        cond_rows = store.read()
        hit = cond_rows.where(F.col("FILIAL") == F.lit(filial))
        new_rows = lambda cur: MU.delete_filial(cur, filial)
        audit_rows = lambda cur: A.audit_delete_filial(cur, filial, ctx)
    else:
        if not filters.any():
            raise ValueError("at least one filter is required to delete records")
        cond_rows = store.read([filters.versao] if filters.versao else None)
        hit = cond_rows.where(F.coalesce(predicate(filters), F.lit(False)))
        new_rows = lambda cur: MU.delete_filtered(cur, filters)
        audit_rows = lambda cur: A.audit_delete_filtered(cur, filters, ctx)
    counts = hit.groupBy("VERSAO").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per version
    touched = [r.VERSAO for r in counts]
    n = sum(r.n for r in counts)
    if n == 0:
        return 0
    current = store.read(touched)
    snapshot = store.commit(new_rows(current), touched=touched, as_of=ctx.as_of)
    audit_log.append(audit_rows(current))  # reads the pre-delete snapshot
    audit_log.put_images(row_images(current, store.read(touched)), snapshot)
    return n
