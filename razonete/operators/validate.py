"""Row transform + validation (G2), source line numbers (S5), error list.

``apply_rules`` is one projection: every rule is a boolean expression and the
faults of a row are an ``array<struct<CAMPO, REGRA, MENSAGEM>>`` column, so a
batch is validated in a single pass inside whole-stage codegen.

Line numbers are computed without ever putting a whole file into one task:
rows are cut into bounded *segments* (range partitions, or file splits),
numbered inside each segment, and each segment is shifted by the row count of
the segments before it in the same file (a tiny prefix sum).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates
from ..schema import FILE_COL, RAW_COLUMNS
from ..sources.store import stage
from .rules import AS_CODED, CATALOGUE, DOCUMENTED, NORMALISED_FIELDS, PREP, Row

ERR_COL = "ERROS"
N_ERR_COL = "N_ERROS"
LINE_COL = "LINHA"
HEADER_LINES = 1  # the header is line 1, the first data row is line 2


def error_struct(field: str, rule_id: str, message: str) -> Column:
    return F.struct(
        F.lit(field).alias("CAMPO"), F.lit(rule_id).alias("REGRA"), F.lit(message).alias("MENSAGEM")
    )


ERROR_TYPE = "array<struct<CAMPO:string,REGRA:string,MENSAGEM:string>>"


def apply_rules(
    df: DataFrame,
    profile: str = AS_CODED,
    date_formats=(dates.DAY_FIRST,),
    rules=None,
) -> DataFrame:
    """Normalise every field and attach the row's faults.

    Columns other than the eleven sheet columns (file name, line number,
    unknown extras) pass through unchanged. Optional columns missing from the
    batch are created empty, TIPO defaults to ``ORCADO``. Invalid cells keep
    their original text (dates and numbers that do not parse become null).

    Two projections: the first computes each normalised value once (regexes,
    date and number parsing), the second evaluates the rules on those columns
    and builds the fault array with ``concat`` of one-element arrays, so the
    whole step stays inside whole-stage codegen (no lambda functions).
    """
    row = Row(df.columns, profile, date_formats, prepared=True)
    plain = Row(df.columns, profile, date_formats)
    prepared = df.select("*", *[plain.compute(f).alias(PREP + f) for f in NORMALISED_FIELDS])
    active = [r for r in (rules if rules is not None else CATALOGUE) if r.applies(row)]
    fails = [(r, r.fails(row)) for r in active]

    filial_ok = ~row.blank("FILIAL") & row.filial().rlike(r"^[0-9]{4}$")
    normalised = {
        "FILIAL": F.when(filial_ok, row.filial()).otherwise(row.raw("FILIAL")),
        "DATA": row.data(),
        "N_CONTA": row.raw("N_CONTA"),
        "N_CENTRO_CUSTO": row.raw("N_CENTRO_CUSTO"),
        "OPERACAO": F.when(row.blank("OPERACAO"), F.lit("")).otherwise(row.norm("OPERACAO")),
        "VALOR": row.valor(),
        "DESCRICAO": row.norm("DESCRICAO"),
        "TIPO": F.when(row.blank("TIPO"), F.lit("ORCADO")).otherwise(row.norm("TIPO")),
        "VERSAO": row.norm("VERSAO") if profile == DOCUMENTED else row.raw("VERSAO"),
        "RATEIO": F.when(row.blank("RATEIO"), F.lit(""))
                   .when(row.norm("RATEIO") == F.lit("NÃO"), F.lit("NAO"))
                   .otherwise(row.norm("RATEIO")),
        "ORIGEM": F.when(row.blank("ORIGEM"), F.lit("")).otherwise(row.norm("ORIGEM")),
    }
    none = F.array().cast(ERROR_TYPE)
    if fails:
        errors = F.concat(*[
            F.when(bad, F.array(error_struct(r.field, r.rule_id, r.message))).otherwise(none) for r, bad in fails
        ]) if len(fails) > 1 else F.when(fails[0][1], F.array(error_struct(
            fails[0][0].field, fails[0][0].rule_id, fails[0][0].message))).otherwise(none)
        n_errors = reduce(lambda a, b: a + b, [bad.cast("int") for _, bad in fails])
    else:
        errors = none
        n_errors = F.lit(0)
    passthrough = [F.col(c) for c in df.columns if c not in normalised]
    return prepared.select(
        *passthrough,
        *[normalised[c].alias(c) for c in RAW_COLUMNS],
        errors.alias(ERR_COL),
        n_errors.alias(N_ERR_COL),
    )


def error_text(sep: str = "; ") -> Column:
    """The row's fault messages joined into one string ('' when none)."""
    return F.concat_ws(sep, F.col(f"{ERR_COL}.MENSAGEM"))


def faulty(df: DataFrame) -> Column:
    """Predicate for rows with at least one fault (works after ``apply_rules``)."""
    return F.col(N_ERR_COL) > 0


# --------------------------------------------------------------------------- #
# Line numbers
# --------------------------------------------------------------------------- #

def number_contiguous(
    df: DataFrame,
    group: str,
    segment: str,
    rowid: str,
    start: int,
    out: str = LINE_COL,
) -> DataFrame:
    """Number rows 1..n inside ``group`` (plus ``start - 1``) without a group-wide task.

    Requirements on the input: the rows of one (group, segment) are contiguous
    inside one partition and in the wanted order, ``rowid`` increases along
    that order (``monotonically_increasing_id`` taken there), and segments
    follow the wanted order inside a group. Then a row's number is its offset
    inside its segment plus the sizes of the group's earlier segments.

    The per-segment sizes are an aggregate over the same input (partial
    aggregation map-side), the prefix sums a window over that small table, and
    the offsets go back with an equi-join on (group, segment) that AQE
    broadcasts when the table is measured small. No task ever holds a group.
    """
    stats = df.groupBy(group, segment).agg(
        F.count(F.lit(1)).alias("_n"), F.min(rowid).alias("_first")
    )
    before = Window.partitionBy(group).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.select(
        group, segment, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    return (
        df.join(offsets, [group, segment])
        .withColumn(out, (F.col("_off") + (F.col(rowid) - F.col("_first")) + F.lit(start)).cast("long"))
        .drop("_off", "_first")
    )


def line_numbers_by_content(
    df: DataFrame, group: str = FILE_COL, order_cols=None, segments: int | None = None, out: str = LINE_COL
) -> DataFrame:
    """S5 for data without a physical order: rank rows of each file by content.

    Line = position in ``ORDER BY order_cols`` within the file, plus one for the
    header. One range shuffle over (file, order columns) cuts a hot file by its
    own content into balanced partitions; each partition is sorted and written
    once to the shared folder with its partition id (the segment) and the place
    of each row among its file's rows there. A file that goes on in a later
    segment is the first one there, so the rows before a segment are known from
    the first and last file of every segment: at most two rows a segment, which
    reach the data by a broadcast whatever the number of files. All is read
    from the written files, so the segments are the same for every consumer.
    Rows without a file have no line and are left out.
    ``order_cols`` must cover every column the caller keeps (rows that tie on
    all of them are identical, so their relative order does not matter).
    """
    order_cols = list(order_cols or [c for c in df.columns if c not in (group,)])
    n = segments or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(group).asc_nulls_first()] + [F.col(c).asc_nulls_first() for c in order_cols]
    at = df.columns.index(group)

    def place(batches):
        last, before = None, 0  # the file of the last row, and how many rows of it have been here
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column(at).dictionary_encode(null_encoding="encode").indices.to_numpy()
            begins = np.flatnonzero(np.diff(codes, prepend=-1))
            runs = np.diff(begins, append=len(codes))
            pos = np.arange(len(codes)) - np.repeat(begins, runs)
            if b.column(at)[0] == last:
                pos[:runs[0]] += before
            last, before = b.column(at)[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pos, pa.int64())], [*b.schema.names, "_pos"])

    placed = stage(
        df.where(F.col(group).isNotNull()).repartitionByRange(n, *order).sortWithinPartitions(*order)
        .mapInArrow(place, T.StructType([*df.schema.fields, T.StructField("_pos", T.LongType())]))
        .withColumn("_seg", F.spark_partition_id()),
        "lines",
    )
    edges = placed.groupBy("_seg").agg(*[f(F.struct(F.col(group).alias("g"), "_pos")).alias(x) for f, x in ((F.min, "_a"), (F.max, "_b"))])
    # the last row of a segment counts its file there; where another file ends the segment, the first one ends in it
    here = Window.partitionBy("g").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    ends = edges.select("_seg", F.col("_b.g").alias("g"), (F.col("_b._pos") + 1).alias("_n")).unionByName(
        edges.where(~F.col("_a.g").eqNullSafe(F.col("_b.g"))).select("_seg", F.col("_a.g").alias("g"), F.lit(0).cast("long").alias("_n")))
    shift = ends.select("_seg", "g", F.coalesce(F.sum("_n").over(here), F.lit(0)).alias("_off")).where("_off > 0")
    shift = F.broadcast(shift.select(F.col("_seg").alias("_s"), "g", "_off"))  # segments, not files
    return (placed.join(shift, (F.col("_seg") == F.col("_s")) & F.col(group).eqNullSafe(F.col("g")), "left")
            .withColumn(out, (F.coalesce("_off", F.lit(0)) + F.col("_pos") + F.lit(HEADER_LINES + 1)).cast("long"))
            .select(*df.columns, out))


def line_numbers_by_position(df: DataFrame, out: str = LINE_COL) -> DataFrame:
    """S5 for rows read from files: physical line in the file.

    Needs the ``_file``, ``_block`` and ``_rowid`` columns added by
    :func:`razonete.sources.files.read_csv_batch` (file path, split start and a
    per-partition increasing id taken right after the scan): a split's rows
    are contiguous and in file order, so the split is the segment.
    """
    return number_contiguous(df, "_file", "_block", "_rowid", start=HEADER_LINES + 1, out=out)


def error_lines(validated: DataFrame, group: str = FILE_COL, line_col: str = LINE_COL) -> DataFrame:
    """One row per fault, ``Linha N: message``, in row then rule order."""
    return (
        validated.where(F.col(N_ERR_COL) > 0)
        .select(group, line_col, F.posexplode(ERR_COL).alias("ORDEM", "E"))
        .select(
            group,
            line_col,
            (F.col("ORDEM") + 1).cast("int").alias("ORDEM"),
            F.col("E.CAMPO").alias("CAMPO"),
            F.col("E.REGRA").alias("REGRA"),
            F.col("E.MENSAGEM").alias("MENSAGEM"),
            F.concat(F.lit("Linha "), F.col(line_col).cast("string"), F.lit(": "), F.col("E.MENSAGEM")).alias("ERRO"),
        )
    )
