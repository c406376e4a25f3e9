"""Product codes of vectors by dual-tree Lloyd rounds in integers.

1. A component x becomes floor(256 * x); vectors are cut into ``PARTS`` equal
   consecutive parts. Every part position has a codebook, first that part of
   the ``ENTRIES`` vectors of the smallest ids.
2. A task takes its rows in chunks. For each part position it builds a
   balanced tree over the chunk's parts and one over the entries; every node
   has a bounding box and the cached sum of its rows. Both trees are descended
   together: an entry node whose smallest distance to a part node is above
   another one's largest distance is pruned. A part node that is left with one
   entry is assigned whole, by its cached sum. Leaves that stay uncertain
   compare integer distances; ties go to the lower entry.
3. Spark adds the tasks' sums for each entry; an entry becomes the floor of
   sum / count, unused entries stay. After ``ROUNDS`` rounds the parts are
   assigned once more.

Only codebooks and their sums (parts x entries x part length, whatever the
table) pass through the driver. All arithmetic is exact in 64-bit integers; a
table whose components are too large for that raises an error.

Defined cases: rows with a null vector or a null or non-finite component are
dropped; shorter vectors count as ending in zeros, and so does a length that
the parts do not divide; the first vectors of equal ids are ordered by their
components, null ids come last; fewer rows than entries give smaller
codebooks; repeated rows are coded each; an empty table gives an empty one.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage
from .vectors import matrix, measured, slices, usable_vectors

PARTS, ENTRIES, ROUNDS = 16, 64, 2
LEAF, CHUNK = 32, 4096      # rows of a leaf and of a tree
PAIRS = 1 << 15             # (leaf, entry) pairs compared at once


class BoxTree:
    """Balanced trees over ``t`` sets of ``leaf * 2**k`` rows each, split at the median of the widest dimension."""

    def __init__(self, rows: np.ndarray, leaf: int):
        t, n, d = rows.shape
        self.order = np.broadcast_to(np.arange(n), (t, n))
        size = n
        while size > leaf:
            nodes = rows.reshape(-1, size, d)
            axis = (nodes.max(1) - nodes.min(1)).argmax(1)
            by = np.take_along_axis(nodes, axis[:, None, None], 2)[:, :, 0].argsort(1, kind="stable")
            rows = np.take_along_axis(nodes, by[:, :, None], 1).reshape(t, n, d)
            self.order = np.take_along_axis(self.order.reshape(-1, size), by, 1).reshape(t, n)
            size //= 2
        self.rows = rows
        nodes = rows.reshape(-1, leaf, d)
        boxes = [(nodes.min(1), nodes.max(1))]
        while len(boxes[0][0]) > t:
            low, high = boxes[0]
            boxes.insert(0, (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])))
        self.boxes = boxes  # by level, the roots first
        self.depth = len(boxes) - 1

    def sums(self, values: np.ndarray) -> list[np.ndarray]:
        """For every level, the sums over its nodes of values (t, n, k), given in the tree's order."""
        t, n, k = values.shape
        out = [values.reshape(len(self.boxes[-1][0]), -1, k).sum(1)]
        while len(out[0]) > t:
            out.insert(0, out[0][::2] + out[0][1::2])
        return out


def _box_distances(p: tuple[np.ndarray, np.ndarray], e: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest squared distance between boxes i of ``p`` and j of ``e``."""
    a, b = e[0][j] - p[1][i], p[0][i] - e[1][j]
    near, far = np.maximum(0, np.maximum(a, b)), np.maximum(e[1][j] - p[0][i], p[1][i] - e[0][j])
    return (near * near).sum(1), (far * far).sum(1)


def _runs(sorted_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and its length."""
    first = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
    return first, np.diff(np.append(first, len(sorted_ids)))


@dataclass
class Assignment:
    entry: np.ndarray   # (t, n) index of the nearest entry, in the rows' given order
    totals: np.ndarray  # (t, entries, d) sums of the assigned rows
    counts: np.ndarray  # (t, entries)


def dual_tree_assign(rows: np.ndarray, books: np.ndarray) -> Assignment:
    """Nearest entries of rows (t, n, d) in books (t, k, d), ties to the lower index."""
    t, n, d = rows.shape
    k = books.shape[1]
    depth = max(0, int(np.ceil(np.log2(n / LEAF)))) if n > LEAF else 0
    full = LEAF << depth
    weight = np.zeros((t, full, 1), np.int64)
    weight[:, :n] = 1                                    # rows that fill up the tree have no weight
    rows = np.concatenate([rows, np.repeat(rows[:, :1], full - n, axis=1)], axis=1)
    wide = 1 << max(0, int(k - 1).bit_length())
    tree = BoxTree(rows, LEAF)
    entries = BoxTree(np.concatenate([books, np.repeat(books[:, -1:], wide - k, axis=1)], axis=1), 1)
    name = np.minimum(entries.order, k - 1).ravel()      # entry of a leaf of the entries' tree
    held = np.take_along_axis(weight, tree.order[:, :, None], 1)
    sums = tree.sums(np.concatenate([tree.rows * held, held], axis=2))
    totals, counts = np.zeros((t, k, d), np.int64), np.zeros((t, k), np.int64)
    entry = np.zeros((t, full), np.int64)                # in the tree's order

    i = j = np.arange(t)                                 # pairs of a part node and an entry node, by part node
    level, below = 0, 0
    while len(i):
        near, far = _box_distances(tree.boxes[level], entries.boxes[below], i, j)
        first, length = _runs(i)
        keep = near <= np.repeat(np.minimum.reduceat(far, first), length)
        i, j = i[keep], j[keep]
        if below == entries.depth:
            first, length = _runs(i)
            sure = np.repeat(length == 1, length)
            node, e = i[sure], name[j[sure]]
            np.add.at(totals, (node >> level, e), sums[level][node, :d])
            np.add.at(counts, (node >> level, e), sums[level][node, d])
            entry.reshape(t << level, -1)[node] = e[:, None]
            i, j = i[~sure], j[~sure]
            if level == tree.depth:
                break
        else:
            below += 1
            i, j = np.repeat(i, 2), (2 * j[:, None] + [0, 1]).ravel()
        if level < tree.depth:
            level += 1
            i, j = (2 * i[:, None] + [0, 1]).ravel(), np.repeat(j, 2)
        by = np.argsort(i, kind="stable")
        i, j = i[by], j[by]

    if len(i):                                           # uncertain leaves: integer distances
        leaves, held = tree.rows.reshape(-1, LEAF, d), held.reshape(-1, LEAF)
        flat, first, own = entries.rows.reshape(-1, d), _runs(i)[0], entry.reshape(-1, LEAF)
        begin = np.unique(first[np.searchsorted(first, np.arange(0, len(i), PAIRS), side="right") - 1])
        for a, b in zip(begin, np.append(begin[1:], len(i))):
            p, q = i[a:b], j[a:b]
            far = np.zeros((len(p), LEAF), np.int64)
            for x in range(d):
                far += (leaves[p, :, x] - flat[q, x][:, None]) ** 2
            first, length = _runs(p)
            least = np.repeat(np.minimum.reduceat(far, first, axis=0), length, axis=0)
            best = np.minimum.reduceat(np.where(far == least, name[q][:, None], k), first, axis=0)
            node = p[first]
            own[node] = best
            part = np.broadcast_to((node >> tree.depth)[:, None], best.shape)
            np.add.at(totals, (part, best), leaves[node] * held[node][:, :, None])
            np.add.at(counts, (part, best), held[node])
    out = np.empty_like(entry)
    np.put_along_axis(out, tree.order, entry, 1)
    return Assignment(out[:, :n], totals, counts)


def _cut(vectors: np.ndarray, parts: int) -> np.ndarray:
    """(rows, width) to (parts, rows, part length)."""
    return vectors.reshape(len(vectors), parts, -1).transpose(1, 0, 2)


def first_books(rows: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors of the ``entries`` smallest ids (that many rows come to the driver)."""
    first = rows.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    return _cut(matrix(pa.array([r.vector for r in first], pa.list_(pa.float64())), width), parts)


def lloyd_round(rows: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """The books after one round; each task sends one row of sums for an entry that it used."""
    parts, k, d = books.shape
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def sums(batches):
        totals, counts = np.zeros(books_shape, np.int64), np.zeros(books_shape[:2], np.int64)
        for b in batches:
            for s in slices(b.num_rows, CHUNK):
                got = dual_tree_assign(_cut(matrix(b.column(0)[s], width), parts), sent.value)
                totals += got.totals
                counts += got.counts
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts.ravel()[used], pa.int64()),
                                          pa.array(totals.reshape(-1, d)[used].tolist(), pa.list_(pa.int64()))], ["slot", "n", "total"])

    books_shape = books.shape
    found = (rows.select("vector").mapInArrow(sums, "slot bigint, n bigint, total array<bigint>").groupBy("slot")
             .agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[x]) for x in range(d))).alias("total")).collect())
    new = books.copy().reshape(-1, d)
    for r in found:
        new[r.slot] = [x // r.n for x in r.total]
    return new.reshape(books.shape)


@dataclass
class Codec:
    books: np.ndarray   # (parts, entries, part length)
    width: int          # length of the vectors, filled up to a multiple of the parts

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def fit(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
        id_col: str = "vec_id", vector_col: str = "embedding") -> Codec:
    """Codebooks learned on all usable rows; without rows they have no entries."""
    rows = usable_vectors(df, id_col, vector_col)
    n, width, _ = measured(rows)
    width = max(1, -(-width // parts)) * parts
    if not n:
        return Codec(np.zeros((parts, 0, width // parts), np.int64), width)
    books = first_books(rows, width, parts, entries)
    for _ in range(rounds):
        books = lloyd_round(rows, books, width)
    return Codec(books, width)


def encode(df: DataFrame, codec: Codec, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, code, error) of every usable row; ``code`` is one byte array of entry indexes."""
    rows = usable_vectors(df, id_col, vector_col, label=F.col(label_col))
    schema = T.StructType([T.StructField("vec_id", T.LongType()), rows.schema["label"],
                           T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    sent, width = rows.sparkSession.sparkContext.broadcast(codec.books), codec.width

    def run(batches):
        books = sent.value
        at = np.arange(books.shape[0])[:, None]
        for b in batches:
            for s in slices(b.num_rows, CHUNK):
                part = _cut(matrix(b.column(1)[s], width), books.shape[0])
                entry = dual_tree_assign(part, books).entry
                error = ((part - books[at, entry]) ** 2).sum((0, 2))
                code = entry.T.astype(np.uint8 if books.shape[1] <= 256 else ">u2")
                yield pa.RecordBatch.from_arrays([b.column(0)[s], b.column(2)[s], pa.array([x.tobytes() for x in code], pa.binary()),
                                                  pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, schema)


def codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): fitted on all usable rows, then every one coded.

    The coded rows are written once; the labels' sums are a table of their own,
    joined to both sides as written, so that a hot label can be split.
    """
    codec = fit(df, id_col=id_col, vector_col=vector_col)
    coded = stage(encode(df, codec, id_col, vector_col, label_col), "dual-codes")
    labels = stage(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "dual-labels")
    return coded.join(labels, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codec.sha256).alias("codebooks_sha256"))
