"""Shared helpers: staged tables, salted joins, bounded bit filters, Arrow batches."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bound_arrow_batches, scratch_path
from ..sources.store import stage

#: a word, everywhere in this subpackage (fixed value)
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["WORD", "stage", "Workspace", "scratch_path", "salted_join", "doc_columns", "row_slices", "text_column", "tidy",
           "mix64", "bit_positions", "pack_two", "collect_two", "bits_hit", "map_batches"]


class Workspace:
    """Tables written by one step, deleted together once nothing reads them any more.

    ``stage`` writes a table under the shared folder and returns it as read
    back; ``close`` deletes all of them. What outlives the step is written
    with ``common.stage`` instead.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, scratch_path(spark, name), 0

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.mode("errorifexists").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def doc_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id (long) and the whole text (null: empty) under fixed names; other columns are dropped."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def salted_join(big: DataFrame, small: DataFrame, on: list[str], spread: list[Column], salts: int = 16,
                how: str = "left") -> DataFrame:
    """Equi-join whose keys may be hot on the ``big`` side only.

    Every row of ``big`` draws one of ``salts`` from the hash of ``spread``
    and ``small`` (at most one row per key) is repeated once per salt, so a
    hot key is dealt over ``salts`` tasks. Rows and results are those of the
    plain join.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


# ------------------------------------------------------------ Arrow batches
def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.LargeStringArray:
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    return col.fill_null("") if col.null_count else col


def row_slices(text: pa.LargeStringArray, max_bytes: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``max_bytes`` of text; a longer text is a range of its own."""
    off = np.frombuffer(text.buffers()[1], "<i8")[text.offset:text.offset + len(text) + 1] if len(text) else np.zeros(1, "i8")
    i, n = 0, len(text)
    while i < n:
        j = int(np.searchsorted(off, off[i] + max_bytes, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def release_memory() -> None:
    """Gives the memory that this worker has freed back to the system, as far as its allocators can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def tidy(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, which releases freed memory behind each task.

    Spark reuses its Python workers; otherwise each keeps, also while idle, about the most that any step took in it.
    """

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return tidied


def map_batches(df: DataFrame, fn: Callable, schema: str, max_bytes: int = 1 << 21) -> DataFrame:
    """``mapInArrow`` over slices of bounded size; ``fn(batch slice)`` returns a RecordBatch or a list of them."""

    def run(batches):
        for batch in batches:
            for i, j in row_slices(text_column(batch), max_bytes):
                out = fn(batch.slice(i, j - i))
                yield from (out if isinstance(out, list) else [out])

    bound_arrow_batches(df.sparkSession)
    return df.mapInArrow(tidy(run), schema)


# ------------------------------------------------------------------ hashing
def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and odd multipliers) over an unsigned array."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


# -------------------------------------------------- filters of a fixed size
# A Bloom filter of a fixed number of bits, whatever the input: it only spares
# work, a false hit is sorted out by an exact step behind it. Its size is a
# parameter, so sending it to every executor has a proven bound.
FILTER_PIECES = 64  # tasks that build a filter, each its own share of the bits


def bit_positions(h: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """``hashes`` bit positions (flat uint64 array) of each 64-bit value; ``bits`` is a power of two."""
    h = mix64(h)
    step = (h >> np.uint64(17)) | np.uint64(1)
    return ((h[None, :] + step[None, :] * np.arange(hashes, dtype=np.uint64)[:, None]) & np.uint64(bits - 1)).ravel()


def bits_hit(filt: np.ndarray, h: np.ndarray, hashes: int) -> np.ndarray:
    bits = len(filt) * 8
    hit = np.ones(len(h), bool)
    m = mix64(h)
    step = (m >> np.uint64(17)) | np.uint64(1)
    for k in range(hashes):
        p = (m + step * np.uint64(k)) & np.uint64(bits - 1)
        hit &= (filt[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return hit


def pack_two(once: np.ndarray, twice: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows (piece, pos, again): offsets of set bits inside each piece, and of those set by several texts."""
    per = np.uint64(bits // FILTER_PIECES)
    cols: list[list] = [[], [], []]
    once, twice = np.unique(once), np.unique(twice)
    edges = np.arange(FILTER_PIECES + 1, dtype=np.uint64) * per
    a, b = np.searchsorted(once, edges), np.searchsorted(twice, edges)
    for p in range(FILTER_PIECES):
        if a[p + 1] > a[p] or b[p + 1] > b[p]:
            cols[0].append(p)
            cols[1].append((once[a[p]:a[p + 1]] - edges[p]).astype("<u4").tobytes())
            cols[2].append((twice[b[p]:b[p + 1]] - edges[p]).astype("<u4").tobytes())
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())],
                                      ["piece", "pos", "again"])


def collect_two(rows: DataFrame, bits: int, which: tuple[str, ...] = ("seen", "more")) -> list[np.ndarray]:
    """The named filters: bits set by any row (seen), bits set by two rows or marked ``again`` (more).

    Their sizes are fixed by ``bits``; the driver takes an eighth at a time.
    """
    size = bits // FILTER_PIECES // 8

    def build(batches):
        own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for piece, pos, again in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                seen, more = own.setdefault(piece, (np.zeros(size * 8, bool), np.zeros(size * 8, bool)))
                p = np.frombuffer(pos.as_buffer(), "<u4")
                more[p[seen[p]]] = True
                seen[p] = True
                more[np.frombuffer(again.as_buffer(), "<u4")] = True
        if own:
            pack = lambda k: pa.array([np.packbits(v[k], bitorder="little").tobytes() for v in own.values()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), *(pack(("seen", "more").index(c)) for c in which)], ["piece", *which])

    out = [np.zeros(bits // 8, np.uint8) for _ in which]
    schema = ", ".join(["piece int", *(f"{c} binary" for c in which)])
    for r in rows.repartition(8, "piece").mapInArrow(tidy(build), schema).toLocalIterator():
        for filt, c in zip(out, which):
            filt[r.piece * size:(r.piece + 1) * size] = np.frombuffer(r[c], np.uint8)
    return out
