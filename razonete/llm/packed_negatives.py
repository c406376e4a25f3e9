"""Hard negatives by Kronecker-packed integer inner products.

1. A component x becomes floor(256 * x). The tasks cut their rows into blocks of
   ``BLOCK`` rows, written once; the anchors are gathered into blocks of
   ``ANCHORS`` rows, written too. Every anchor block meets every row block in
   one cell: a task pairs one part of each, read from the written files.
2. In a cell, the candidates' components of one dimension are biased to be
   non-negative and set side by side into separated fields of one wide
   integer. For each anchor, every wide integer is multiplied once by the
   anchor's (biased) component; the products' sum holds all inner products in
   its fields, from which the biases are taken off again. Fields are as wide
   as the largest possible sum, so the scores are exact.
3. First the cells give each anchor's best rows of its own label (its
   positives); a cell sends at most ``POSITIVES`` rows for an anchor. With these
   scores known, the cells give for each positive the best rows of other
   labels whose score lies in the window, again at most ``NEGATIVES`` each.

The work is anchors x rows, as asked; a cell's memory is bounded, and parts
are paired without a key, so none is hot. No blocks pass through the driver:
a planner that sees the files as small would broadcast every copy of them.

Defined cases: rows with a null label, a null vector or a null or non-finite
component take no part; shorter vectors count as ending in zeros; rows without
an id come last among equal scores and are no anchors; every row is a row of
its own, also where ids or whole rows repeat (a repeated row may be a positive
of its copy, a repeated anchor gives its rows again); an empty table gives an
empty one; other columns are ignored. Components too large for exact 64-bit
sums raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .vectors import matrix, measured, slices, usable_vectors

BLOCK, ANCHORS = 2048, 512   # rows and anchors of a cell
POSITIVES, NEGATIVES, MIN_PERCENT = 5, 5, 80
_BLOCKS = "block bigint, ids array<bigint>, labels array<bigint>, anchor array<boolean>, vectors binary"
_ANCHORS = "uid bigint, vec_id bigint, label bigint, vector binary"


# ------------------------------------------------------- packed products
class PackedRows:
    """Candidate vectors (rows, width) as one wide integer for each dimension."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.bias = -min(0, int(rows.min())) if rows.size else 0
        self.most = int(rows.max()) + self.bias if rows.size else 0
        self.sums = rows.sum(1)
        self.packed: dict[int, list[int]] = {}

    def _wide(self, field: int) -> list[int]:
        """The wide integers with fields of ``field`` bytes."""
        if field not in self.packed:
            bytes_ = np.zeros((self.rows.shape[1], len(self.rows), field), np.uint8)
            bytes_[:, :, :8] = np.ascontiguousarray((self.rows + self.bias).T, "<u8").view(np.uint8).reshape(bytes_.shape[0], -1, 8)[:, :, :field]
            self.packed[field] = [int.from_bytes(x.tobytes(), "little") for x in bytes_]
        return self.packed[field]

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products (anchors, rows) as 64-bit integers."""
        n, width = self.rows.shape
        out = np.zeros((len(anchors), n), np.int64)
        if not anchors.size or not n:
            return out
        lift = -min(0, int(anchors.min()))
        most = width * (int(anchors.max()) + lift) * self.most   # no field can exceed this
        field = 4 if most < 1 << 32 else 8 if most < 1 << 63 else (most.bit_length() + 7) // 8
        wide = self._wide(field)
        for k, a in enumerate(anchors.tolist()):
            total = 0
            for x, w in zip(a, wide):
                if x + lift:
                    total += (x + lift) * w
            raw = total.to_bytes(n * field, "little")
            own = self.bias * sum(a) + width * lift * self.bias
            if field <= 8:
                out[k] = np.frombuffer(raw, f"<u{field}").astype(np.int64) - lift * self.sums - own
            else:
                out[k] = [int.from_bytes(raw[i:i + field], "little") - lift * s - own for i, s in zip(range(0, n * field, field), self.sums.tolist())]
        return out


def _best(row: np.ndarray, col: np.ndarray, score: np.ndarray, first: int) -> np.ndarray:
    """Indexes of the ``first`` best of each row: higher scores first, then lower columns."""
    by = np.lexsort((col, -score, row))
    r = row[by]
    start = np.searchsorted(r, r)
    return by[np.arange(len(r)) - start < first]


# ------------------------------------------------------------------ blocks
def row_blocks(rows: DataFrame, width: int, size: int) -> DataFrame:
    """The rows as blocks of up to ``size``, each in the order of its ids (rows without one last).

    Blocks are numbered so that a row's uid is its block's number plus its place.
    """

    def run(batches):
        seq = TaskContext.get().partitionId() << 40
        for b in batches:
            for s in slices(b.num_rows, size):
                part = b.slice(s.start, s.stop - s.start)
                part = pa.Table.from_batches([part]).sort_by([("vec_id", "ascending")])
                v = matrix(part["vector"], width)
                yield pa.RecordBatch.from_arrays([pa.array([seq], pa.int64())] + [pa.array([part[c].to_pylist()], pa.list_(t)) for c, t in (
                    ("vec_id", pa.int64()), ("label", pa.int64()), ("anchor", pa.bool_()))] + [pa.array([v.astype("<i8").tobytes()], pa.binary())],
                    ["block", "ids", "labels", "anchor", "vectors"])
                seq += len(v)

    return rows.mapInArrow(run, _BLOCKS)


def _unpacked(raw: pa.Scalar, width: int) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, width)


def anchor_rows(blocks: DataFrame, width: int) -> DataFrame:
    """(uid, vec_id, label, vector) of the anchors; uid tells rows apart."""

    def run(batches):
        for b in batches:
            for block, ids, labels, anchor, v in zip(*b.columns):
                at = np.flatnonzero(anchor.values.to_numpy(zero_copy_only=False))
                v = _unpacked(v, width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.as_py() + at, pa.int64()), ids.values.take(pa.array(at)), labels.values.take(pa.array(at)),
                     pa.array([v[k].tobytes() for k in at], pa.binary())], ["uid", "vec_id", "label", "vector"])

    return blocks.mapInArrow(run, _ANCHORS)


def _anchor_blocks(anchors: DataFrame, n: int, wanted: str, size: int) -> DataFrame:
    """Rows of up to ``size`` anchors: arrays of uid, vec_id and label, their vectors in a row, and ``wanted`` of each."""
    schema = "uids array<bigint>, a_ids array<bigint>, a_labels array<bigint>, a_vectors binary, wanted array<array<struct<id:bigint,score:bigint>>>"
    pair = pa.list_(pa.struct([("id", pa.int64()), ("score", pa.int64())]))

    def run(batches):
        for b in batches:
            for s in slices(b.num_rows, size):
                part = [c[s] for c in b.columns]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part[k].to_pylist()], pa.list_(pa.int64())) for k in range(3)]
                    + [pa.array([b"".join(part[3].to_pylist())], pa.binary()), pa.array([part[4].to_pylist()], pa.list_(pair))],
                    ["uids", "a_ids", "a_labels", "a_vectors", "wanted"])

    return (anchors.select("uid", "vec_id", "label", "vector", F.expr(wanted).alias("wanted"))
            .repartition(max(1, -(-n // size)), "uid").mapInArrow(run, schema))


def _cells(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every row block beside every anchor block, never by a broadcast of either."""
    return blocks.hint("shuffle_replicate_nl").crossJoin(anchors).select(
        "block", "ids", "labels", "vectors", "uids", "a_ids", "a_labels", "a_vectors", "wanted")


def _cell_arrays(cell: tuple, width: int) -> tuple:
    """A cell's row ids, labels and vectors, and the anchors' uids, ids, labels and vectors."""
    block, ids, labels, v, uids, a_ids, a_labels, a_v = cell
    arr = lambda x: x.values.to_numpy(zero_copy_only=False)
    return (block.as_py(), ids.values, arr(labels), _unpacked(v, width), arr(uids), a_ids.values, arr(a_labels), _unpacked(a_v, width))


def positive_candidates(cells: DataFrame, width: int, first: int = POSITIVES) -> DataFrame:
    """(uid, id, score): of each cell, an anchor's best other rows of its label."""

    def run(batches):
        for b in batches:
            for cell in zip(*b.columns[:8]):
                block, ids, labels, v, uids, _, a_labels, a_v = _cell_arrays(cell, width)
                for label in np.intersect1d(labels, a_labels):
                    col, who = np.flatnonzero(labels == label), np.flatnonzero(a_labels == label)
                    score = PackedRows(v[col]).scores(a_v[who])
                    other = (block + col)[None, :] != uids[who][:, None]
                    r, c = np.nonzero(other)
                    s = score[r, c]
                    pick = _best(r, c, s, first)
                    yield pa.RecordBatch.from_arrays([pa.array(uids[who][r[pick]], pa.int64()), ids.take(pa.array(col[c[pick]])), pa.array(s[pick], pa.int64())],
                                                     ["uid", "id", "score"])

    return cells.mapInArrow(run, "uid bigint, id bigint, score bigint")


def negative_candidates(cells: DataFrame, width: int, min_percent: int, first: int = NEGATIVES) -> DataFrame:
    """(uid, nth, anchor_id, positive_id, positive_score, negative_id, negative_score): of each cell, the best in each window."""
    names = ["uid", "nth", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def run(batches):
        for b in batches:
            for cell in zip(*b.columns):
                _, ids, labels, v, uids, a_ids, a_labels, a_v = _cell_arrays(cell[:8], width)
                wanted = [x or [] for x in cell[8].as_py()]
                score = PackedRows(v).scores(a_v)
                differ = labels[None, :] != a_labels[:, None]
                for nth in range(max(map(len, wanted), default=0)):
                    who = np.array([k for k, x in enumerate(wanted) if len(x) > nth])
                    p = [wanted[k][nth] for k in who]
                    high = np.array([x["score"] for x in p], np.int64)
                    low = np.array([-(-min_percent * x["score"] // 100) for x in p], np.int64)
                    r, c = np.nonzero(differ[who] & (score[who] <= high[:, None]) & (score[who] >= low[:, None]))
                    s = score[who[r], c]
                    pick = _best(r, c, s, first)
                    at = r[pick]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(uids[who[at]], pa.int64()), pa.array(np.full(len(at), nth + 1), pa.int32()), a_ids.take(pa.array(who[at])),
                        pa.array([p[k]["id"] for k in at], pa.int64()), pa.array(high[at], pa.int64()), ids.take(pa.array(c[pick])), pa.array(s[pick], pa.int64())], names)

    return cells.mapInArrow(run, "uid bigint, nth int, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")


def _first(rows: DataFrame, keys: list[str], score: str, id_: str, first: int) -> DataFrame:
    """The best rows of each key with their ``rank``; Spark cuts each key's rows in the tasks before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(id_).asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)


def hard_negatives(df: DataFrame, anchor: Column, min_percent: int = MIN_PERCENT, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK, block_anchors: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchor`` marks.

    A negative's label differs from the anchor's, and its score is at least
    ``min_percent`` hundredths of the positive's and at most the positive's.
    """
    rows = usable_vectors(df.where(F.col(label_col).isNotNull()), id_col, vector_col, label=F.col(label_col).cast("long"),
                          anchor=F.coalesce(anchor & F.col(id_col).isNotNull(), F.lit(False)))
    _, width, _ = measured(rows)
    width = max(1, width)
    blocks = stage(row_blocks(rows, width, block), "packed-rows")
    anchors = stage(anchor_rows(blocks, width), "packed-anchors")
    n = anchors.count()
    none = "cast(null as array<struct<id:bigint,score:bigint>>)"
    own = stage(_anchor_blocks(anchors, n, none, block_anchors), "packed-anchors")
    found = positive_candidates(_cells(blocks, own), width, positives)
    best = stage(_first(found, ["uid"], "score", "id", positives).groupBy("uid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))), lambda x: F.struct(x.id.alias("id"), x.score.alias("score"))).alias("wanted")),
        "packed-positives")
    own = stage(_anchor_blocks(anchors.join(best, "uid"), n, "wanted", block_anchors), "packed-anchors")
    found = negative_candidates(_cells(blocks, own), width, min_percent, negatives)
    return _first(found, ["uid", "nth"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
