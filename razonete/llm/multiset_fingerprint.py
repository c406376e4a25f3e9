"""Homomorphic multiset fingerprints of documents.

A text is the multiset of its paragraphs (lines). Each paragraph is hashed to
a wide vector and a text's fingerprint is the sum of its paragraphs' vectors,
lane by lane, modulo powers of two: it does not depend on the order, and
paragraphs can be added to or taken from a fingerprint without the rest of
the text. The vector has two parts:

* ``EQUAL_LANES`` lanes modulo 2**64 of pseudo-random values: equal sums mean
  equal multisets, up to chance;
* ``LIKE_LANES`` lanes modulo 2**32: every run of ``SHINGLE`` words inside the
  paragraph (the whole paragraph if shorter) adds a pseudo-random +1 or -1 to
  each lane. The squared distance of two such sums estimates how many runs
  differ, hence the likeness ``1 - |a-b|^2 / (|a|^2 + |b|^2)``, cut at 0.

Defined cases: a null text is empty (one empty paragraph); equal texts have
equal fingerprints; two texts without words are alike (1) if equal, else 0;
rows that share an id follow each other in the order of their texts; null ids
come first; the only row of a table is its own next document.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, map_batches, mix64, row_slices, text_column
from .textscan import rolling, span_hash, words

EQUAL_LANES, LIKE_LANES, SHINGLE = 8, 128, 3
_SEEDS = mix64(np.arange(1, EQUAL_LANES + 3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _paragraphs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every line; a text has one more line than line breaks."""
    brk = np.flatnonzero(data == 10)
    doc = np.searchsorted(off, brk, side="right") - 1
    n = len(off) - 1
    per = np.bincount(doc, minlength=n) + 1
    owner = np.repeat(np.arange(n), per)
    start, end = np.empty(len(owner), np.int64), np.empty(len(owner), np.int64)
    first = np.cumsum(per) - per
    inner = np.arange(len(brk)) + doc  # the line that each break ends
    end[inner], end[first + per - 1] = brk, off[1:]
    start[first], start[inner + 1] = off[:-1], brk + 1
    return start, end, owner


def sums(text: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The two parts of the fingerprint of each text: (n, EQUAL_LANES) uint64 and (n, LIKE_LANES) int32."""
    w = words(text)
    n = len(text)
    start, end, owner = _paragraphs(w.data, w.offsets)
    full = end > start
    h = np.full(len(start), 0x5851F42D4C957F2D, np.uint64)
    h[full] = span_hash(w.data, start[full], end[full])
    equal = np.empty((n, EQUAL_LANES), np.uint64)
    cut = np.searchsorted(owner, np.arange(n))
    for k in range(EQUAL_LANES):
        equal[:, k] = np.add.reduceat(mix64(h ^ _SEEDS[k]), cut) if n else 0
    # runs of words, each inside one paragraph
    line = np.searchsorted(start, w.start, side="right") - 1 if len(w.start) else np.zeros(0, np.int64)
    first = np.searchsorted(line, np.arange(len(start) + 1))
    count = np.diff(first)
    runs = rolling(w.hash, SHINGLE)
    place = np.arange(len(runs))
    inside = place[line[place] == line[place + SHINGLE - 1]] if len(runs) else place
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    s = np.concatenate([runs[inside], mix64(h[short])])
    doc = np.concatenate([owner[line[inside]], owner[short]])
    order = np.argsort(doc, kind="stable")
    s, doc = s[order], doc[order]
    like = np.zeros((n, LIKE_LANES), np.int32)
    step = 1 << 16
    for a in range(0, len(s), step):
        part, d = s[a:a + step], doc[a:a + step]
        bits = np.unpackbits(np.stack([mix64(part ^ _SEEDS[-2]), mix64(part ^ _SEEDS[-1])], axis=1).view(np.uint8), axis=1)
        at = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        like[d[at]] += 2 * ones - np.diff(np.append(at, len(d)))[:, None].astype(np.int32)
    return equal, like


def combine(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], remove: bool = False):
    """Fingerprint of ``a`` with the paragraphs of ``b`` inserted (or deleted): lane sums modulo powers."""
    if remove:
        return a[0] - b[0], a[1] - b[1]
    return a[0] + b[0], a[1] + b[1]


def texts_of(fp: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """Fingerprints as text (base64 of the little-endian lanes)."""
    raw = np.concatenate([fp[0].astype("<u8").view(np.uint8), fp[1].astype("<i4").view(np.uint8)], axis=1)
    return [base64.b64encode(r.tobytes()).decode() for r in raw]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    x, y = a[1].astype(float), b[1].astype(float)
    total = (x ** 2).sum(axis=1) + (y ** 2).sum(axis=1)
    same = (a[0] == b[0]).all(axis=1)
    near = 1 - ((x - y) ** 2).sum(axis=1) / np.where(total > 0, total, 1)
    return np.where(same, 1.0, np.where(total > 0, np.clip(near, 0, 1), 0.0))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every whole text."""
    return map_batches(doc_columns(docs, id_col, text_col), lambda b: pa.RecordBatch.from_arrays(
        [b.column(0), pa.array(texts_of(sums(text_column(b))))], ["doc_id", "fingerprint"]), "doc_id bigint, fingerprint string")


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows of (doc_id, text) dealt to ranges of ids, each range in order and followed by a look at the next row.

    Range borders are quantiles of the ids, so a range holds about 1/buckets
    of the rows; the driver sees the borders and one smallest id a range. A
    range's last row needs the first row of the range behind it: rows with
    that id are sent to both (column ``peek``).
    """
    spark = docs.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    qs = [i / n for i in range(1, n)]
    row = docs.agg(F.percentile_approx(key, F.array(*map(F.lit, qs)), F.lit(max(10_000, 20 * n))).alias("q")).first() if qs else None
    borders = sorted(set((row.q if row else None) or []))
    keyed = docs.withColumn("bucket", _range_of(key, borders))
    heads = sorted((r.bucket, r.head) for r in keyed.groupBy("bucket").agg(F.min(key).alias("head")).collect())
    if not heads:
        return docs.withColumn("bucket", F.lit(0)).withColumn("peek", F.lit(0))
    # by range: its smallest id and the range before it; the last range looks at the very first row
    head, before = [None] * (len(borders) + 1), [None] * (len(borders) + 1)
    for i, (b, low) in enumerate(heads):
        head[b], before[b] = low, heads[i - 1][0]
    here = lambda values, kind: F.element_at(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("bucket") + 1)
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("peek"))
    look = F.struct(here(before, "int").alias("bucket"), F.lit(1).alias("peek"))
    place = F.explode(F.when(key == here(head, "bigint"), F.array(own, look)).otherwise(F.array(own)))
    return (keyed.withColumn("place", place).select("doc_id", "text", "place.bucket", "place.peek")
            .repartition(n, "bucket")
            .sortWithinPartitions("bucket", "peek", "doc_id", "text"))


def _range_of(key: Column, borders: list[int]) -> Column:
    """The number of borders below the key, by halving: about log2 steps a row, however many borders."""
    if not borders:
        return F.lit(0)
    at = F.array(*map(F.lit, borders)).cast("array<bigint>")
    size = 1 << len(borders).bit_length()
    steps = F.array(*[F.lit(size >> k) for k in range(1, size.bit_length())])

    def halve(low: Column, step: Column) -> Column:
        return F.when((low + step <= len(borders)) & (F.get(at, low + step - 1) < key), low + step).otherwise(low)

    return F.aggregate(steps, F.lit(0), halve)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter is taken from the next document."""

    def one(text: pa.LargeStringArray, follow: pa.LargeStringArray, ids: pa.Array) -> pa.RecordBatch:
        own = text.to_pylist()
        n = [len(t) for t in own]
        edited = [t[:k - k // 4] + f[:k // 4] for t, k, f in zip(own, n, follow.to_pylist())]
        fp, next_fp = sums(text), sums(follow)
        new = sums(pa.array(edited, pa.large_string()))
        return pa.RecordBatch.from_arrays([
            ids, pa.array(n, pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array(texts_of(fp)), pa.array(texts_of(new)), pa.array(likeness(fp, new)), pa.array(likeness(fp, next_fp))],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        held = None  # the row that still waits for its next one
        for batch in batches:
            for i, j in row_slices(text_column(batch)):
                b = batch.slice(i, j - i)
                rows = pa.Table.from_batches(([held] if held is not None else []) + [b]).combine_chunks().to_batches()[0]
                held = rows.slice(rows.num_rows - 1)
                if rows.num_rows < 2:
                    continue
                bucket, peek = rows.column(2).to_numpy(), rows.column(3).to_numpy()
                text = text_column(rows)
                # a row is answered by the row behind it in its range; rows only looked at are not answered
                done = np.flatnonzero((peek[:-1] == 0) & (bucket[:-1] == bucket[1:]))
                if len(done):
                    yield one(text.take(pa.array(done)), text.take(pa.array(done + 1)), rows.column(0).take(pa.array(done)))

    return with_next(doc_columns(docs, id_col, text_col)).mapInArrow(
        run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
