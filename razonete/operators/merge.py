"""Upsert family.

The reference's MERGE overwrites every non-key column of a matched row and
inserts unmatched rows, so it is exactly ``target ANTI source  UNION  source``
on the four-column key. The key includes account and cost centre, so the join
hash spreads even when one version holds most rows; a small batch is
broadcast by AQE after measuring it, a large one is sort-merge joined.
Duplicate source keys are reduced with an aggregate (``max`` of a struct led
by the timestamp), never with a window, so a key repeated a billion times is
pre-aggregated map-side instead of landing in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEYS, LEDGER_COLUMNS, STATUS_FULL, STATUS_PARTIAL

MODE_AUTO = "auto"                 # as coded: delete only when the version is empty (a no-op)
MODE_REPLACE = "replace_version"   # as documented: a full import replaces the version
ACTION_UPDATED = "ATUALIZADO"
ACTION_INSERTED = "INSERIDO"
ACTION_KEPT = "MANTIDO"


def batch_versions(batch: DataFrame) -> DataFrame:
    return batch.select("VERSAO").distinct()


def version_counts(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Existing ledger rows for every version present in the batch."""
    existing = target.groupBy("VERSAO").agg(F.count(F.lit(1)).alias("REGISTROS_EXISTENTES"))
    return batch_versions(batch).join(existing, "VERSAO", "left").select(
        "VERSAO", F.coalesce("REGISTROS_EXISTENTES", F.lit(0)).cast("long").alias("REGISTROS_EXISTENTES")
    )


def import_mode(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Per version, full import when the ledger has no row of it, else partial.

    Classified per version (a batch may carry several), with the batch row count.
    """
    sizes = batch.groupBy("VERSAO").agg(F.count(F.lit(1)).alias("TOTAL_REGISTROS"))
    return version_counts(target, batch).join(sizes, "VERSAO").select(
        "VERSAO",
        "REGISTROS_EXISTENTES",
        "TOTAL_REGISTROS",
        F.when(F.col("REGISTROS_EXISTENTES") == 0, F.lit(STATUS_FULL)).otherwise(F.lit(STATUS_PARTIAL)).alias("STATUS"),
    )


def replace_version(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Drop every ledger row of the versions present in the batch."""
    return target.join(batch_versions(batch), "VERSAO", "left_anti").select(*target.columns)


def dedup_latest(batch: DataFrame, keys=KEYS, order: str = "DATA_ATUALIZACAO") -> DataFrame:
    """U4: one row per key, the one with the latest ``order`` value.

    Ties on the timestamp are broken by the remaining columns in descending
    order (nulls lowest), so the result is deterministic.
    """
    rest = [c for c in batch.columns if c not in keys and c != order]
    best = F.max(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in rest])).alias("_best")
    return batch.groupBy(*keys).agg(best).select(
        *keys, F.col("_best._o").alias(order), *[F.col(f"_best.{c}").alias(c) for c in rest]
    ).select(*batch.columns)


def duplicate_keys(batch: DataFrame, keys=KEYS) -> DataFrame:
    """Report of merge keys that occur more than once in a batch."""
    return batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("OCORRENCIAS")).where(F.col("OCORRENCIAS") > 1)


def stamp(batch: DataFrame, as_of) -> DataFrame:
    """Set DATA_ATUALIZACAO to the caller's clock (the reference uses now())."""
    if as_of is None:
        return batch
    ts = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")
    return batch.withColumn("DATA_ATUALIZACAO", ts)


def merge_upsert(
    target: DataFrame,
    batch: DataFrame,
    as_of=None,
    mode: str = MODE_AUTO,
    dedup: bool = True,
    keys=KEYS,
) -> DataFrame:
    """The ledger after merging ``batch`` (both in ledger schema)."""
    source = batch.select(*LEDGER_COLUMNS)
    if dedup:
        source = dedup_latest(source, keys)
    source = stamp(source, as_of)
    if mode == MODE_REPLACE:
        target = replace_version(target, source)
    elif mode != MODE_AUTO:
        raise ValueError(f"unknown merge mode {mode!r}")
    kept = target.select(*LEDGER_COLUMNS).join(source.select(*keys), list(keys), "left_anti")
    return kept.select(*LEDGER_COLUMNS).unionByName(source.select(*LEDGER_COLUMNS))


def merge_actions(target: DataFrame, batch: DataFrame, dedup: bool = True, keys=KEYS) -> DataFrame:
    """How many rows a merge updates, inserts and leaves alone, per version."""
    source = dedup_latest(batch.select(*LEDGER_COLUMNS), keys) if dedup else batch
    t = target.select(*keys, F.lit(True).alias("_t"))
    s = source.select(*keys, F.lit(True).alias("_s"))
    both = t.join(s, list(keys), "full_outer")
    action = (
        F.when(F.col("_t").isNotNull() & F.col("_s").isNotNull(), F.lit(ACTION_UPDATED))
        .when(F.col("_s").isNotNull(), F.lit(ACTION_INSERTED))
        .otherwise(F.lit(ACTION_KEPT))
    )
    return both.groupBy("VERSAO", action.alias("ACAO")).agg(F.count(F.lit(1)).alias("REGISTROS"))
