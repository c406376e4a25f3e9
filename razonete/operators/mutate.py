"""Set-based edits and deletes (M1-M7) as functional table rewrites.

Parquet tables support neither UPDATE nor DELETE, so every mutation returns
the new ledger as a DataFrame (committed by :mod:`razonete.sources.store`).
An edit set or key set is joined on the four-column key: AQE broadcasts it
when it is measured small, otherwise both sides are hash-partitioned by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date_flex
from ..schema import EDITABLE, KEYS, LEDGER_COLUMNS
from .merge import stamp
from .query import Filters, predicate

NEW = "NOVO_"  # prefix of the requested value of a column in an edit set
# --- fixed values: how a missing old value is written in the change list ----
NONE_TEXT = "None"
NOT_FOUND = "Registro não encontrado"
HIT = "_hit"  # marks the records that an edit was found for
# -----------------------------------------------------------------------------


def typed_keys(requests: DataFrame) -> DataFrame:
    """Key dates given as text are parsed like the edit/delete forms (N8, four patterns)."""
    if dict(requests.dtypes).get("DATA") == "string":
        return requests.withColumn("DATA", parse_date_flex("DATA"))
    return requests


def edit_lookup(ledger: DataFrame, edits: DataFrame) -> DataFrame:
    """M1: each requested key with the stored record, ENCONTRADO false when absent."""
    edits = typed_keys(edits)
    stored = ledger.select(*KEYS, *[F.col(c).alias(f"ATUAL_{c}") for c in EDITABLE if c not in KEYS],
                           F.lit(True).alias("_hit"))
    return edits.select(*KEYS).join(stored, KEYS, "left").select(
        *KEYS,
        F.coalesce("_hit", F.lit(False)).alias("ENCONTRADO"),
        *[f"ATUAL_{c}" for c in EDITABLE if c not in KEYS],
        F.when(F.col("_hit").isNull(), F.lit(NOT_FOUND)).alias("MENSAGEM"),
    )


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.coalesce(c.cast("string"), F.lit(NONE_TEXT)), F.lit("'"))


def _change(name: str, old: Column, new: Column) -> Column:
    if name == "VALOR":
        shown = F.concat(F.lit("VALOR: "), F.coalesce(old.cast("string"), F.lit(NONE_TEXT)),
                         F.lit(" -> "), F.coalesce(new.cast("string"), F.lit(NONE_TEXT)))
    else:
        shown = F.concat(F.lit(f"{name}: "), _quoted(old), F.lit(" -> "), _quoted(new))
    return F.when(~old.eqNullSafe(new), shown)


def edit_diff(ledger: DataFrame, edits: DataFrame) -> DataFrame:
    """M2: per found record, the list ``F: 'old' -> 'new'`` of changed fields.

    Fields are compared null-safely in the reference's order; VALOR is shown
    unquoted; an empty ALTERACOES means nothing would change.
    """
    return changes_of(ledger.join(one_edit_per_key(edits), KEYS, "inner"))


def changes_of(hits: DataFrame) -> DataFrame:
    """The change list of records joined with their edits."""
    changes = F.concat_ws(", ", *[_change(c, F.col(c), F.col(f"{NEW}{c}")) for c in EDITABLE])
    return hits.select(
        *KEYS,
        *[F.col(f"{NEW}{c}") for c in ("N_CONTA", "N_CENTRO_CUSTO")],
        changes.alias("ALTERACOES"),
    )


def one_edit_per_key(edits: DataFrame) -> DataFrame:
    """Reduce an edit set to one request per key (deterministic: the greatest values).

    An aggregate, so a key requested many times is collapsed map-side; it also
    keeps the update join from multiplying ledger rows.
    """
    edits = typed_keys(edits)
    new = [f"{NEW}{c}" for c in EDITABLE]
    best = F.max(F.struct(*[F.col(c) for c in new])).alias("_e")
    return edits.groupBy(*KEYS).agg(best).select(*KEYS, *[F.col(f"_e.{c}").alias(c) for c in new])


def apply_edits(ledger: DataFrame, edits: DataFrame, as_of=None) -> DataFrame:
    """M3: set the eight editable columns (and the timestamp) of every row with the key.

    DATA and VERSAO are never changed. Rows without an edit are untouched.
    """
    return edited(with_edits(ledger, one_edit_per_key(edits)), as_of)


def with_edits(ledger: DataFrame, edits: DataFrame) -> DataFrame:
    """Every record with the values asked for it, null and not marked where no edit has its key; ``edits``: one a key."""
    return ledger.join(edits.withColumn(HIT, F.lit(True)), KEYS, "left").select(
        *LEDGER_COLUMNS, *[f"{NEW}{c}" for c in EDITABLE], F.col(HIT).isNotNull().alias(HIT))


def edited(joined: DataFrame, as_of=None) -> DataFrame:
    """The records of :func:`with_edits` after their edits."""
    hit = F.col(HIT)
    if as_of is None:
        ts = F.col("DATA_ATUALIZACAO")
    else:
        ts = F.lit(as_of).cast("timestamp_ntz") if not isinstance(as_of, Column) else as_of
    out = []
    for c in LEDGER_COLUMNS:
        if c in EDITABLE:
            out.append(F.when(hit, F.col(f"{NEW}{c}")).otherwise(F.col(c)).alias(c))
        elif c == "DATA_ATUALIZACAO":
            out.append(F.when(hit, ts).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def edit_key_collisions(ledger: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits whose new account / cost centre would collide with another record, or with another edit's new key."""
    found = one_edit_per_key(edits).join(ledger.select(*KEYS).distinct(), KEYS, "left_semi")
    new = rekeyed(found)
    twice = new.groupBy(*KEYS).count().where("count > 1").select(*KEYS)
    return new.join(ledger.select(*KEYS), KEYS, "left_semi").unionByName(twice).distinct()


def rekeyed(found: DataFrame) -> DataFrame:
    """The new keys of edits that change theirs."""
    return found.where(
        ~F.col(f"{NEW}N_CONTA").eqNullSafe(F.col("N_CONTA"))
        | ~F.col(f"{NEW}N_CENTRO_CUSTO").eqNullSafe(F.col("N_CENTRO_CUSTO"))
    ).select(
        F.col(f"{NEW}N_CONTA").alias("N_CONTA"), F.col(f"{NEW}N_CENTRO_CUSTO").alias("N_CENTRO_CUSTO"), "DATA", "VERSAO"
    )


def delete_keys(ledger: DataFrame, keys: DataFrame) -> DataFrame:
    """M4: remove every row whose key is in ``keys``."""
    keys = typed_keys(keys)
    return ledger.join(keys.select(*KEYS), KEYS, "left_anti").select(*ledger.columns)


def _keep_unless(cond: Column) -> Column:
    # SQL DELETE removes rows where the condition is TRUE; NULL keeps the row
    return ~F.coalesce(cond, F.lit(False))


def delete_version(ledger: DataFrame, versao: str) -> DataFrame:
    """M5: remove a version (a partition filter on a VERSAO-partitioned table)."""
    return ledger.where(_keep_unless(F.col("VERSAO") == F.lit(versao)))


def delete_filial(ledger: DataFrame, filial: str) -> DataFrame:
    """M6: remove every row of a branch."""
    return ledger.where(_keep_unless(F.col("FILIAL") == F.lit(filial)))


def delete_filtered(ledger: DataFrame, f: Filters) -> DataFrame:
    """M7: remove the rows matching the filters; at least one filter is required."""
    if not f.any():
        raise ValueError("at least one filter is required to delete records")
    return ledger.where(_keep_unless(predicate(f)))


def deleted_count(ledger: DataFrame, cond: Column) -> DataFrame:
    """How many rows a delete removes (the audit records the true count)."""
    return ledger.agg(F.count_if(F.coalesce(cond, F.lit(False))).cast("long").alias("TOTAL"))


__all__ = [
    "edit_lookup", "edit_diff", "apply_edits", "edit_key_collisions", "delete_keys",
    "delete_version", "delete_filial", "delete_filtered", "deleted_count", "stamp",
]
