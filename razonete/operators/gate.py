"""Batch-level gates (G4-G8): whole-file rejection and export checks.

A file is rejected when any of its rows has a fault. The validated rows are
written once to the shared folder, so the rules run once; the set of bad files
is an aggregate (partial aggregation map-side, so a hot file costs one row per
map task) that is written as well. The split is a ``left_anti`` / ``left_semi``
join of two plain scans: AQE broadcasts the set when its measured size is
under the threshold, and beyond it can split a hot file in the sort-merge
join, as neither side is an aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FILE_COL, LEDGER_COLUMNS
from ..sources.store import stage
from .validate import N_ERR_COL

ACCEPTED = "ACEITO"
REJECTED = "REJEITADO"


def bad_files(validated: DataFrame, file_col: str = FILE_COL) -> DataFrame:
    """Files with at least one faulty row.

    Written as an aggregate filtered afterwards (a HAVING): the predicate on
    the fault count cannot be pushed below the rule projection, so rules are
    evaluated once per row in the parallel stage, and partial aggregation
    reduces each file to one row per map task before the shuffle.
    """
    return (
        validated.groupBy(file_col)
        .agg(F.max(F.col(N_ERR_COL)).alias("_max_err"))
        .where(F.col("_max_err") > 0)
        .select(file_col)
    )


def split_files(validated: DataFrame, file_col: str = FILE_COL) -> tuple[DataFrame, DataFrame]:
    """(rows of files without any fault, rows of the others), from one evaluation of the rules."""
    rows = stage(validated, "validated")
    bad = stage(bad_files(rows, file_col), "bad-files")
    return rows.join(bad, file_col, "left_anti"), rows.join(bad, file_col, "left_semi")


def accepted_rows(validated: DataFrame, file_col: str = FILE_COL) -> DataFrame:
    """Rows of files without any fault."""
    return split_files(validated, file_col)[0]


def rejected_rows(validated: DataFrame, file_col: str = FILE_COL) -> DataFrame:
    """Every row (faulty or not) of a file with at least one fault."""
    return split_files(validated, file_col)[1]


def file_gate(validated: DataFrame, file_col: str = FILE_COL) -> DataFrame:
    """One verdict per file with its row and fault counts."""
    return (
        validated.groupBy(file_col)
        .agg(
            F.count(F.lit(1)).alias("TOTAL_LINHAS"),
            F.count_if(F.col(N_ERR_COL) > 0).alias("LINHAS_COM_ERRO"),
            F.sum(F.col(N_ERR_COL)).cast("long").alias("TOTAL_ERROS"),
        )
        .withColumn(
            "STATUS", F.when(F.col("LINHAS_COM_ERRO") > 0, F.lit(REJECTED)).otherwise(F.lit(ACCEPTED))
        )
    )


def gate_centro_custo(ledger_rows: DataFrame, group_col: str | None = None) -> DataFrame:
    """Rows whose cost centre is not exactly 9 characters long."""
    bad = F.count_if(F.coalesce(F.length("N_CENTRO_CUSTO") != 9, F.lit(True))).alias("CENTROS_INVALIDOS")
    total = F.count(F.lit(1)).alias("TOTAL")
    grouped = ledger_rows.groupBy(group_col) if group_col else ledger_rows.groupBy()
    return grouped.agg(total, bad).withColumn("OK", F.col("CENTROS_INVALIDOS") == 0)


def gate_profile(ledger_rows: DataFrame, columns=None) -> DataFrame:
    """G7 + G8 in one aggregate pass: row count and null count per column.

    Returns one row per column: (COLUNA, TOTAL, NULOS, OK); OK is false when
    the batch is empty or the column has nulls.
    """
    columns = list(columns or [c for c in LEDGER_COLUMNS if c in ledger_rows.columns])
    wide = ledger_rows.agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(columns)],
    )
    pairs = ", ".join(f"'{c}', _n{i}" for i, c in enumerate(columns))
    long = wide.selectExpr("_total AS TOTAL", f"stack({len(columns)}, {pairs}) AS (COLUNA, NULOS)")
    return long.select(
        "COLUNA", "TOTAL", F.col("NULOS").cast("long").alias("NULOS"),
        ((F.col("TOTAL") > 0) & (F.col("NULOS") == 0)).alias("OK"),
    )
