"""Repeated passages by fixed-block anchors.

Every ``WINDOW``-word passage contains a whole block of ``BLOCK`` words that
starts at a multiple of ``BLOCK`` in its document (``WINDOW = 2 * BLOCK - 1``).
So if a passage of one document occurs in another, a block of the first occurs
there too, at any offset:

1. index: the non-overlapping blocks of every document;
2. probe: every rolling ``BLOCK``-word window is looked up; a hit that is not
   the document's own block, or a block of two documents, is an anchor;
3. extend: an anchor is extended by the words around it to the full windows
   that hold it, and those windows are matched exactly, by hash, across all
   documents. A document's words covered by a matching window are a union of
   maximal repeats; they are removed where a smaller id has the window.

Index and anchors are kept as bit filters of a fixed size (``FILTER_BITS``),
whatever the input: false hits only add rows to step 3, where they meet no
equal. When the corpus outgrows the filters, step 3 gets more rows.

Defined cases: a text of fewer than ``WINDOW`` words loses nothing; a null text
has no words; a null id neither removes nor loses words; rows that share an id
do not remove from each other; other columns are kept by ``drop_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_positions, bits_hit, collect_two, doc_columns, map_batches, mix64, pack_two, row_slices, salted_join, stage, text_column, tidy
from .textscan import Words, rolling, run_starts, words

WINDOW, BLOCK = 13, 7
FILTER_BITS, FILTER_HASHES = 1 << 28, 3  # 32 MB
SLICE_BYTES = 1 << 18  # text of a slice: its arrays are many times as large (filters take larger ones: a slice gives them 64 rows)


def _blocks(w: Words, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rolling block hashes, which of them lie in one text, and which begin at a multiple of ``block`` in it."""
    r = rolling(w.hash, block)
    ok = run_starts(w.first, block)
    doc = w.doc[:len(r)]
    return r, ok, ok & ((np.arange(len(r)) - w.first[doc]) % block == 0)


def _own(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One key per (hash, text)."""
    return mix64(h + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def anchor_filter(docs: DataFrame, block: int = BLOCK, bits: int = FILTER_BITS) -> np.ndarray:
    """Bits of all anchors: blocks of one document that occur in another one."""
    sc = docs.sparkSession.sparkContext

    def index(b: pa.RecordBatch) -> pa.RecordBatch:
        w = words(text_column(b))
        r, _, aligned = _blocks(w, block)
        at = np.flatnonzero(aligned)
        _, one = np.unique(_own(r[at], w.doc[at]), return_index=True)   # once a document
        h, times = np.unique(r[at[one]], return_counts=True)
        return pack_two(bit_positions(h, bits, FILTER_HASHES), bit_positions(h[times > 1], bits, FILTER_HASHES), bits)

    blocks, shared = collect_two(map_batches(docs, index, "piece int, pos binary, again binary"), bits)
    known = sc.broadcast(blocks)
    del blocks

    def probe(b: pa.RecordBatch) -> pa.RecordBatch:
        w = words(text_column(b))
        r, ok, aligned = _blocks(w, block)
        at = np.flatnonzero(ok & ~aligned)
        at = at[bits_hit(known.value, r[at], FILTER_HASHES)]
        own = np.flatnonzero(aligned)
        at = at[~np.isin(_own(r[at], w.doc[at]), _own(r[own], w.doc[own]))]  # not its own block once more
        return pack_two(bit_positions(np.unique(r[at]), bits, FILTER_HASHES), np.zeros(0, np.uint64), bits)

    found = collect_two(map_batches(docs, probe, "piece int, pos binary, again binary"), bits, ("seen",))[0]
    known.unpersist()
    found |= shared
    return found


def _windows(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    return rolling(w.hash, window), run_starts(w.first, window)


def exact_copies(docs: DataFrame) -> DataFrame:
    """Ids (of one row each) whose whole word sequence is that of a smaller id."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        w = words(text_column(b))
        place = np.arange(len(w.hash), dtype=np.uint64) - w.first[w.doc].astype(np.uint64)
        keys = []
        for seed in (0x94D049BB133111EB, 0xD6E8FEB86659FD93):
            part = np.append(mix64(w.hash ^ mix64((place + np.uint64(1)) * np.uint64(seed))), np.uint64(0))
            total = np.where(w.counts > 0, np.add.reduceat(part, w.first[:-1]), 0) if len(w.counts) else np.zeros(0, np.uint64)
            keys.append(pa.array(total.astype(np.uint64).view(np.int64)))
        return pa.RecordBatch.from_arrays([b.column(0), *keys, pa.array(w.counts, pa.int64())], ["doc_id", "k1", "k2", "n"])

    rows = stage(map_batches(docs, run, "doc_id bigint, k1 bigint, k2 bigint, n bigint", SLICE_BYTES).where("n > 0"), "anchor-sequences")
    once = rows.groupBy("doc_id").agg(F.count("*").alias("rows"), F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first("n").alias("n"))
    once = once.where("rows = 1").drop("rows")
    low = rows.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("last")).where("low < last").drop("last")
    return salted_join(once, low, ["k1", "k2", "n"], [F.col("doc_id")], how="inner").where("doc_id > low").select("doc_id")


def repeated_windows(docs: DataFrame, window: int = WINDOW, bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, windows, copy): hashes of a document's windows that also start in a document with a smaller id.

    An exact copy (by words) of a smaller id is only marked: all its windows
    start there too. Its windows add nothing to those of its first document.
    """
    docs = docs.where("doc_id is not null")
    copies = stage(exact_copies(docs), "anchor-copies")  # a table of files: Spark sends it whole only where it is small
    docs = docs.join(copies, "doc_id", "left_anti")
    block = (window + 1) // 2
    anchors = docs.sparkSession.sparkContext.broadcast(anchor_filter(docs, block, bits))

    def extend(b: pa.RecordBatch) -> pa.RecordBatch:
        w = words(text_column(b))
        r, ok, _ = _blocks(w, block)
        at = np.flatnonzero(ok)
        hit = np.zeros(len(r) + 1, np.int64)
        hit[at[bits_hit(anchors.value, r[at], FILTER_HASHES)] + 1] = 1
        upto = np.cumsum(hit)
        h, inside = _windows(w, window)
        at = np.flatnonzero(inside)
        at = at[upto[np.minimum(at + window - block + 1, len(r))] > upto[at]]  # windows that hold an anchor
        doc = w.doc[at]
        _, one = np.unique(_own(h[at], doc), return_index=True)
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc[one])), pa.array(h[at[one]].view(np.int64))], ["doc_id", "h"])

    rows = stage(map_batches(docs, extend, "doc_id bigint, h bigint", SLICE_BYTES), "anchor-windows")
    # written and read again, so that both sides of the join are plain shuffles, whose hot keys Spark splits
    first = stage(rows.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("last"))
                  .where("low < last").drop("last"), "anchor-first")
    found = rows.join(first, "h").where("doc_id > low").groupBy("doc_id").agg(F.collect_set("h").alias("windows"))
    return found.withColumn("copy", F.lit(False)).unionByName(
        copies.select("doc_id", F.lit(None).cast("array<bigint>").alias("windows"), F.lit(True).alias("copy")))


def covered(w: Words, lists: pa.Array, copy: pa.Array, window: int) -> np.ndarray:
    """Mask of the words inside the listed windows of their text; of a copy, all words if it has a window."""
    whole = copy.fill_null(False).to_numpy(zero_copy_only=False) & (w.counts >= window)
    mask = np.zeros(len(w.hash) + 1, np.int64)
    if lists.null_count < len(lists):
        flat = lists.flatten().to_numpy().view(np.uint64)
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
        h, inside = _windows(w, window)
        at = np.flatnonzero(inside)
        at = at[np.isin(_own(h[at], w.doc[at]), _own(flat, owner))]
        np.add.at(mask, at, 1)
        np.add.at(mask, at + window, -1)
    return (np.cumsum(mask[:-1]) > 0) | whole[w.doc]


def _kept_texts(w: Words, gone: np.ndarray) -> list[bytes]:
    raw = w.data.tobytes()
    keep = ~gone
    spans = [(a, b) for a, b in zip(w.start[keep].tolist(), w.end[keep].tolist())]
    cut = np.concatenate([[0], np.cumsum(keep)])[w.first].tolist()
    return [b" ".join([raw[a:b] for a, b in spans[i:j]]) for i, j in zip(cut[:-1], cut[1:])]


def removal_digests(docs: DataFrame, window: int = WINDOW, bits: int = FILTER_BITS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    docs = doc_columns(docs, id_col, text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        w = words(text_column(b))
        gone = covered(w, b.column(2), b.column(3), window)
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(w.counts, pa.int64()), pa.array(np.bincount(w.doc[gone], minlength=len(w.counts)), pa.int64()),
             pa.array([hashlib.sha256(t).hexdigest() for t in _kept_texts(w, gone)])], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    marked = docs.join(repeated_windows(docs, window, bits), "doc_id", "left").select("doc_id", "text", "windows", "copy")
    return map_batches(marked, run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string", SLICE_BYTES)


def drop_repeats(docs: DataFrame, window: int = WINDOW, bits: int = FILTER_BITS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """All rows and columns; texts that lose words become their kept words joined by a space, others stay as they are."""
    windows = repeated_windows(doc_columns(docs, id_col, text_col), window, bits).withColumnRenamed("doc_id", "_id").withColumnRenamed(
        "windows", "_windows").withColumnRenamed("copy", "_copy")
    marked = docs.join(windows, docs[id_col].cast("long") == windows["_id"], "left").drop("_id")
    names, schema = docs.columns, docs.schema
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            for i, j in row_slices(text_column(batch, text_col), SLICE_BYTES):
                b = batch.slice(i, j - i)
                w = words(text_column(b, text_col))
                gone = covered(w, b.column(b.num_columns - 2), b.column(b.num_columns - 1), window)
                lost = np.bincount(w.doc[gone], minlength=b.num_rows) > 0
                old = b.column(at).to_pylist()
                new = [t.decode() if x else o for t, x, o in zip(_kept_texts(w, gone), lost, old)]
                cols = [pa.array(new, b.schema.field(at).type) if k == at else b.column(k) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays(cols, names)

    return marked.mapInArrow(tidy(run), schema)
