"""Ledger and audit tables on plain parquet.

Parquet has no MERGE, UPDATE or DELETE, so the ledger is kept copy-on-write
at version granularity: each commit writes only the VERSAO partitions it
changes into a fresh directory, and a small append-only commit log lists,
per snapshot, which directory holds each live version. Untouched versions are
referenced, not copied. A snapshot becomes visible only when its log rows are
appended, and no commit ever overwrites a path that is being read.

The log also keeps the columns each directory was written with. Directories
of one column set are read by one scan, whatever the number of commits, and
columns that a directory lacks are filled with the reader's defaults (S10).
Rows are stored in the order of ``clustered``.

The log holds one row per live version per snapshot (a few hundred rows), so
reading it on the driver is metadata, not data. One writer at a time is
assumed (the stream's micro-batches are sequential); folders no longer
referenced by the latest snapshot can be removed by a retention job.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import json
import uuid
from collections import defaultdict
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import AUDIT_COLUMNS, AUDIT_SCHEMA, IMAGE_SCHEMA, LEDGER_SCHEMA
from ..session import scratch_path
from .clustered import PAGE_ROWS, write_clustered

LOG_SCHEMA = T.StructType([
    T.StructField("SNAPSHOT", T.LongType(), False),
    T.StructField("VERSAO", T.StringType(), True),
    T.StructField("DIRETORIO", T.StringType(), True),
    T.StructField("LOTE", T.StringType(), True),
    T.StructField("GRAVADO_EM", T.TimestampNTZType(), True),
    T.StructField("COLUNAS", T.StringType(), True),  # the directory's columns and types; null: LEDGER_SCHEMA
])
PART = "PARTICAO"  # partition column: a digest of VERSAO, so any text (the empty one too) is a version
COMPACT = {"compression": "zstd"}  # for tables of whole rows that are written once and read a few times
EMPTY_MARK = None  # a snapshot row with VERSAO = null records a commit that left no version


def stage(df: DataFrame, name: str = "stage", **options) -> DataFrame:
    """Write a batch once to the shared checkpoint folder and read it back.

    Cuts the lineage: every later action (gates, ledger write, audit, metrics)
    reads these files instead of recomputing from the source, and a lost
    executor re-reads files rather than re-running the validation. ``options``
    are the writer's.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def part_of(versao) -> str:
    return hashlib.md5((versao or "").encode()).hexdigest()


@dataclass(frozen=True)
class Stored:
    """Where a live version lies, and the columns it was written with (JSON of a StructType)."""

    directory: str
    columns: str

    def path(self, versao: str) -> str:
        return f"{self.directory}/{PART}={part_of(versao)}"


class LedgerStore:
    """A ledger table partitioned by a digest of VERSAO (null counts as '').

    ``schema`` is what commits write and reads return, :data:`LEDGER_SCHEMA` unless given. Versions written under
    another schema keep theirs: on read their columns are cast by name, missing ones get ``defaults`` (null without
    one), columns that the reader's schema lacks stay unread. A commit writes the versions it touches in ``schema``.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType = LEDGER_SCHEMA, defaults: dict | None = None,
                 page_rows: int = PAGE_ROWS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.schema = schema
        self.defaults = defaults or {}
        self.page_rows = page_rows

    # ------------------------------------------------------------------ log
    @property
    def log_path(self) -> str:
        return f"{self.root}/_log"

    def _log(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(LOG_SCHEMA).parquet(self.log_path)
        except AnalysisException:
            return None

    def snapshot_id(self) -> int:
        log = self._log()
        if log is None:
            return 0
        v = log.agg(F.max("SNAPSHOT")).first()[0]
        return int(v or 0)

    def stored(self) -> dict[str, Stored]:
        """VERSAO -> place and columns of its partition in the current snapshot."""
        log = self._log()
        if log is None:
            return {}
        sid = self.snapshot_id()
        rows = log.where(F.col("SNAPSHOT") == sid).where(F.col("VERSAO").isNotNull()).collect()
        return {r.VERSAO: Stored(r.DIRETORIO, r.COLUNAS or LEDGER_SCHEMA.json()) for r in rows}

    def live(self) -> dict[str, str]:
        """VERSAO -> directory of its partition in the current snapshot."""
        return {v: s.directory for v, s in self.stored().items()}

    def has_batch(self, lote: str) -> bool:
        log = self._log()
        if log is None:
            return False
        return log.where(F.col("LOTE") == lote).limit(1).count() > 0

    # ----------------------------------------------------------------- read
    def read(self, versions=None) -> DataFrame:
        """The current ledger, or only ``versions`` of it: one scan for each stored column set."""
        wanted = None if versions is None else {v or "" for v in versions}
        by_columns: dict[str, list[str]] = defaultdict(list)
        for v, s in sorted(self.stored().items()):
            if wanted is None or v in wanted:
                by_columns[s.columns].append(s.path(v))
        out = None
        for columns, paths in sorted(by_columns.items()):
            part = self._conform(self.spark.read.schema(T.StructType.fromJson(json.loads(columns))).parquet(*paths))
            out = part if out is None else out.unionByName(part)
        # an empty relation that the optimiser knows as one: a merge into it joins nothing
        return self.spark.createDataFrame([], self.schema).limit(0) if out is None else out

    def _conform(self, df: DataFrame) -> DataFrame:
        """The reader's columns of stored rows; a column they lack holds its default."""
        cols = []
        for f in self.schema.fields:
            c = F.col(f.name) if f.name in df.columns else F.lit(self.defaults.get(f.name))
            same = f.name in df.columns and df.schema[f.name].dataType == f.dataType
            cols.append(c if same else c.cast(f.dataType).alias(f.name))
        return df.select(*cols)

    # --------------------------------------------------------------- commit
    def commit(self, rows: DataFrame, touched, removed=(), lote: str | None = None,
               as_of: _dt.datetime | None = None, written: bool = False) -> int:
        """Publish a snapshot where the versions in ``touched`` hold ``rows``.

        ``rows`` must contain every row of the touched versions (it replaces
        them); versions in ``removed`` disappear; other versions are carried
        by reference. ``written``: the rows are read from files as they are, with
        no join or aggregate behind them. Returns the new snapshot id.
        """
        sid = self.snapshot_id() + 1
        # a unique folder per attempt: a commit that died before its log row was
        # appended leaves an invisible folder behind, and the retry never collides with it
        directory = f"{self.root}/snapshots/s={sid:010d}-{uuid.uuid4().hex[:12]}"
        touched = {v or "" for v in touched}
        written: set[str] = set()
        if touched:
            out = (rows.select(*self.schema.names).withColumn("VERSAO", F.coalesce("VERSAO", F.lit("")))
                   .where(F.col("VERSAO").isin(sorted(touched))).withColumn(PART, F.md5("VERSAO")))
            # arranging reads its rows three times (quantiles, range borders, exchange): a merge or an edit runs once
            write_clustered(out if written else stage(out, "commit", **COMPACT), directory, PART, self.page_rows)
            kept = T.StructType([*self.schema.fields, T.StructField(PART, T.StringType(), True)])
            parts = {r[PART] for r in self.spark.read.schema(kept).parquet(directory).select(PART).distinct().collect()}
            written = {v for v in touched if part_of(v) in parts}
        live = {v: s for v, s in self.stored().items() if v not in touched and v not in {x or "" for x in removed}}
        live.update({v: Stored(directory, self.schema.json()) for v in written})
        stamp = as_of or _dt.datetime(1970, 1, 1)
        log_rows = ([(sid, v, s.directory, lote, stamp, s.columns) for v, s in sorted(live.items())]
                    or [(sid, EMPTY_MARK, None, lote, stamp, None)])
        self.spark.createDataFrame(log_rows, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(self.log_path)
        return sid

    def replace_all(self, rows: DataFrame, lote: str | None = None, as_of=None) -> int:
        """Publish ``rows`` as the whole ledger (every current version is replaced)."""
        versions = {r.VERSAO for r in rows.select("VERSAO").distinct().collect()}
        return self.commit(rows, touched=versions | set(self.live()), lote=lote, as_of=as_of)


class AuditLog:
    """Append-only audit table (schema :data:`AUDIT_SCHEMA`)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def append(self, rows: DataFrame) -> None:
        rows.select(*AUDIT_COLUMNS).write.mode("append").parquet(f"{self.path}/manual")

    def put_batch(self, rows: DataFrame, lote: str) -> None:
        """Idempotent write for a stream micro-batch: a replay rewrites the same folder."""
        rows.select(*AUDIT_COLUMNS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lote={lote}")

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(AUDIT_SCHEMA).option("recursiveFileLookup", True).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], AUDIT_SCHEMA)

    def put_images(self, images: DataFrame, snapshot: int) -> None:
        """The change table of a commit, beside the audit texts; the same snapshot rewrites its own folder."""
        (images.withColumn("SNAPSHOT", F.lit(snapshot).cast("long")).select(*IMAGE_SCHEMA.names)
         .write.mode("overwrite").parquet(f"{self.path}_imagens/{snapshot:010d}"))

    def images(self) -> DataFrame:
        try:
            return self.spark.read.schema(IMAGE_SCHEMA).option("recursiveFileLookup", True).parquet(f"{self.path}_imagens")
        except AnalysisException:
            return self.spark.createDataFrame([], IMAGE_SCHEMA)


def append_table(df: DataFrame, path: str) -> None:
    """Append rows to a parquet table."""
    df.write.mode("append").parquet(path)


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union a table written before RATEIO/ORIGEM existed with current rows."""
    from ..operators.project import conform

    return conform(old.unionByName(new, allowMissingColumns=True))
