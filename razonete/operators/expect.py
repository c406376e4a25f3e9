"""Declarative expectation suite (E1-E6), evaluated in one aggregate pass.

A suite is a list of specs. Column existence and declared type are schema
metadata (no job); value expectations are ``count_if`` terms of a single
``agg``, unpivoted to one row per expectation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXISTS = "expect_column_to_exist"
OF_TYPE = "expect_column_values_to_be_of_type"
NOT_NULL = "expect_column_values_to_not_be_null"
GREATER = "expect_column_values_to_be_greater_than"
REGEX = "expect_column_values_to_match_regex"

# --- fixed values: the shipped suite --------------------------------------
DEFAULT_SUITE_CONFIG = {
    "required_columns": ["codigo", "descricao", "valor", "data"],
    "column_types": {"codigo": "int64", "descricao": "str", "valor": "float64", "data": "datetime64[ns]"},
    "validation_rules": {"valor": {"min": 0}, "descricao": {"regex": r"^[A-Za-z0-9\s\-\.]+$"}},
}
# pandas dtype names -> Spark types a column may have to satisfy them
DTYPE_TO_SPARK = {
    "int64": ("bigint", (T.LongType, T.IntegerType, T.ShortType, T.ByteType)),
    "str": ("string", (T.StringType,)),
    "float64": ("double", (T.DoubleType, T.FloatType)),
    "datetime64[ns]": ("timestamp", (T.TimestampType, T.TimestampNTZType)),
}
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Expectation:
    kind: str
    column: str
    arg: object = None


def suite_from_config(cfg=DEFAULT_SUITE_CONFIG) -> list[Expectation]:
    """The shipped config as specs, in the order they are declared."""
    s = [Expectation(EXISTS, c) for c in cfg["required_columns"]]
    s += [Expectation(OF_TYPE, c, t) for c, t in cfg["column_types"].items()]
    s += [Expectation(NOT_NULL, c) for c in cfg["required_columns"]]
    rules = cfg["validation_rules"]
    for c, r in rules.items():
        if "min" in r:
            s.append(Expectation(GREATER, c, r["min"]))
    for c, r in rules.items():
        if "regex" in r:
            s.append(Expectation(REGEX, c, r["regex"]))
    return s


def run_suite(df: DataFrame, suite: list[Expectation]) -> DataFrame:
    """One row per expectation: (ORDEM, EXPECTATIVA, COLUNA, TOTAL, FALHAS, SUCESSO).

    FALHAS counts offending values (for existence: 1 when the column is
    missing). Null values are ignored by the type, range and regex checks.
    """
    schema = {f.name: f.dataType for f in df.schema.fields}
    terms, meta = [], []
    for i, e in enumerate(suite):
        present = e.column in schema
        if e.kind == EXISTS or not present:
            bad = F.lit(0 if present else 1)
        elif e.kind == OF_TYPE:
            target, ok_types = DTYPE_TO_SPARK[e.arg]
            if isinstance(schema[e.column], ok_types):
                bad = F.lit(0)
            else:  # declared type differs: count values that do not convert
                c = F.col(e.column)
                bad = F.count_if(c.isNotNull() & c.try_cast(target).isNull())
        elif e.kind == NOT_NULL:
            bad = F.count_if(F.col(e.column).isNull())
        elif e.kind == GREATER:
            bad = F.count_if(F.col(e.column) <= F.lit(e.arg))
        elif e.kind == REGEX:
            bad = F.count_if(~F.col(e.column).cast("string").rlike(e.arg))
        else:
            raise ValueError(f"unknown expectation {e.kind!r}")
        terms.append(bad.cast("long").alias(f"_b{i}"))
        meta.append((i, e))
    wide = df.agg(F.count(F.lit(1)).alias("_total"), *terms)
    pairs = ", ".join(f"{i + 1}, '{e.kind}', '{e.column}', _b{i}" for i, e in meta)
    long = wide.selectExpr("_total", f"stack({len(meta)}, {pairs}) AS (ORDEM, EXPECTATIVA, COLUNA, FALHAS)")
    return long.select(
        F.col("ORDEM").cast("int").alias("ORDEM"), "EXPECTATIVA", "COLUNA",
        F.col("_total").alias("TOTAL"), F.col("FALHAS"), (F.col("FALHAS") == 0).alias("SUCESSO"),
    )


def suite_success(results: DataFrame) -> DataFrame:
    """Overall flag and the list of failed expectations."""
    return results.agg(
        F.bool_and("SUCESSO").alias("SUCESSO"),
        F.array_sort(F.collect_list(F.when(~F.col("SUCESSO"), F.concat_ws(":", "EXPECTATIVA", "COLUNA")))).alias("FALHAS"),
    )


def expectation_input(spark: SparkSession, orders: DataFrame) -> DataFrame:
    """Map ``orders`` onto the suite's columns (codigo, descricao, valor, data)."""
    return orders.select(
        F.col("o_orderkey").alias("codigo"),
        F.col("o_orderpriority").alias("descricao"),
        F.col("o_totalprice").alias("valor"),
        F.col("o_orderdate").alias("data"),
    )
