"""Row images of a change (A2, A3): what every changed row was before it and is after it.

Two states of the ledger are compared row for row, with nulls equal and repeated
rows counted: every row of the old state counts -1, every row of the new one +1,
and rows whose sum is not zero have changed. That is one aggregate with map-side
partial sums, so neither a hot version nor a hot key lands in one task, and
unchanged rows leave the plan there. A key that has one row before and one after is an
update with both images; all else is a removal or an insertion with its number of
repeats. An edit that changes the key itself is a removal and an insertion.

``replay`` applies a change table to the state it was taken from and gives the
state after it. -0.0 counts as 0.0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import IMAGE_AFTER, IMAGE_BEFORE, KEYS, LEDGER_COLUMNS
from ..sources.store import stage

KIND, TIMES = "TIPO", "VEZES"
UPDATED, INSERTED, REMOVED = "ATUALIZADO", "INSERIDO", "REMOVIDO"
REST = [c for c in LEDGER_COLUMNS if c not in KEYS]


def signed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows that differ, with how many more (or fewer) of them the new state holds."""
    both = before.select(*LEDGER_COLUMNS, F.lit(-1).alias(TIMES)).unionByName(after.select(*LEDGER_COLUMNS, F.lit(1).alias(TIMES)))
    return both.groupBy(*LEDGER_COLUMNS).agg(F.sum(TIMES).alias(TIMES)).where(F.col(TIMES) != 0)


def row_images(before: DataFrame, after: DataFrame) -> DataFrame:
    """The change table: TIPO, the key, ANTES_* and DEPOIS_* of the other columns, VEZES."""
    rows = stage(signed_rows(before, after), "signed")  # the changed rows only; read twice below
    was, now = (F.when(cond, F.struct(*REST)) for cond in (F.col(TIMES) < 0, F.col(TIMES) > 0))
    n = F.abs(TIMES)
    keyed = rows.groupBy(*KEYS).agg(F.max(was).alias("_was"), F.max(now).alias("_now"), F.count(was).alias("_b"), F.count(now).alias("_a"),
                                    F.min(n).alias(TIMES), F.max(n).alias("_hi"))
    paired = (F.col("_b") <= 1) & (F.col("_a") <= 1) & (F.col(TIMES) == F.col("_hi"))
    rest = keyed.where(~paired).select(*[F.col(c).alias(f"_{c}") for c in KEYS])
    same_key = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEYS])
    alone = rows.join(rest, same_key, "left_semi").select(*KEYS, was.alias("_was"), now.alias("_now"), n.alias(TIMES))
    kind = F.when(F.col("_was").isNull(), INSERTED).when(F.col("_now").isNull(), REMOVED).otherwise(UPDATED)
    return keyed.where(paired).select(*KEYS, "_was", "_now", TIMES).unionByName(alone).select(
        kind.alias(KIND), *KEYS, *[F.col(f"_was.{c}").alias(IMAGE_BEFORE + c) for c in REST],
        *[F.col(f"_now.{c}").alias(IMAGE_AFTER + c) for c in REST], TIMES)


def replay(state: DataFrame, images: DataFrame) -> DataFrame:
    """``state`` after the changes of ``images``; fails where they remove rows that it does not hold."""

    def side(prefix: str, without: str, sign: int) -> DataFrame:
        return images.where(F.col(KIND) != without).select(
            *[F.col(c) if c in KEYS else F.col(prefix + c).alias(c) for c in LEDGER_COLUMNS], (sign * F.col(TIMES)).alias(TIMES))

    rows = state.select(*LEDGER_COLUMNS, F.lit(1).cast("long").alias(TIMES)).unionByName(
        side(IMAGE_BEFORE, INSERTED, -1)).unionByName(side(IMAGE_AFTER, REMOVED, 1))
    left = rows.groupBy(*LEDGER_COLUMNS).agg(F.sum(TIMES).alias(TIMES)).where(F.col(TIMES) != 0)
    n = F.when(F.col(TIMES) < 0, F.raise_error(F.lit("row images of another state")).cast("long")).otherwise(F.col(TIMES))
    return left.withColumn(TIMES, F.explode(F.sequence(F.lit(1).cast("long"), n))).drop(TIMES)
