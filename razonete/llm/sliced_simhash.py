"""SimHash near-duplicates by bit-sliced comparison.

1. A text's fingerprint has 64 bits; a bit is 1 where more than half of the
   hashes (XXH64) of its ``SHINGLE``-word shingles, repeats included, have it.
2. Texts of one fingerprint form a class. Two fingerprints within ``RADIUS``
   bits agree in three of ``RADIUS + 3`` blocks of bits at least, so every
   choice of three blocks deals the distinct fingerprints into buckets by those
   blocks' bits, and no link is missed.
3. A bucket's members are stored vertically: one word holds one bit of 64
   members (a bit plane). For a query member, each plane's difference is added
   to the 64 distances at once by carry-save counters, one word for each
   binary digit; a counter that runs over marks its member as beyond the
   radius for good. Blocks of 64 whose members are all beyond it are abandoned.
4. A task links what it found to components of its bucket and sends one row
   for each member, never its pairs. The links of all buckets are closed to
   components.

A bucket of more than ``CELL`` members is cut into parts, and every two parts
meet in a task of their own, so a task's memory is bounded. Nothing passes
through the driver.

Defined cases: null and empty texts and texts without words have fingerprint
zero, which links like any other; fewer words than a shingle are one shingle;
a null id keeps its row, its component is the smallest id of its component
(null if there is none); rows that share an id are placed each by its own text;
an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, doc_columns, map_batches, stage, text_column
from .odd_sketch import components
from .textscan import lower_ascii, text_bytes, word_spans

SHINGLE, SEED, RADIUS = 3, 42, 3
CELL = 8192                # members that a task compares at once, about
PAIRS = 1 << 16            # (query, word of 64 members) pairs at once
_CHUNK = 1 << 18           # shingles hashed at once
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ------------------------------------------------------------ fingerprints
def _spaced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words, each followed by one space, and where they begin (with the total length at the end)."""
    size = end - start + 1
    at = np.concatenate([[0], np.cumsum(size)])
    take = np.repeat(start - at[:-1], size) + np.arange(at[-1])
    out = data[np.minimum(take, len(data) - 1)]
    out[at[1:] - 1] = 0x20
    return out.tobytes(), at


def fingerprints(text: pa.LargeStringArray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64-bit fingerprints of the texts."""
    data, off = text_bytes(text)
    data = lower_ascii(data)
    start, end, first = word_spans(data, off)
    count = np.diff(first)
    shingles = np.where(count < shingle, np.minimum(count, 1), count - shingle + 1)
    doc = np.repeat(np.arange(len(count)), shingles)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    begin = first[doc] + nth                                    # first and last word of each shingle
    last = begin + np.minimum(count[doc], shingle) - 1
    ones = np.zeros((len(count), 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(doc), _CHUNK):
        j = min(len(doc), i + _CHUNK)
        a, b = int(begin[i]), int(last[j - 1]) + 1
        raw, at = _spaced(data, start[a:b], end[a:b])
        h = np.fromiter((digest(raw[x:y], seed) for x, y in zip(at[begin[i:j] - a].tolist(), (at[last[i:j] - a + 1] - 1).tolist())), np.uint64, j - i)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        new = np.flatnonzero(np.concatenate([[True], doc[i + 1:j] != doc[i:j - 1]]))
        ones[doc[i:j][new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    return np.packbits((2 * ones > shingles[:, None]).astype(np.uint8), axis=1, bitorder="little").view("<u8").ravel()


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` holds the 64 bits as a signed number."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(text_column(b)).view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs, run, "doc_id bigint, fp bigint")


# ------------------------------------------------- bit-sliced comparison
def bit_planes(values: np.ndarray) -> np.ndarray:
    """(64, words): word w of plane p holds bit p of members 64 w to 64 w + 63; ``values`` are a multiple of 64."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within_radius(planes: np.ndarray, query: np.ndarray, word: np.ndarray, beyond: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (query member, word of members): the indexes of the pairs not abandoned, and the bits of members within the radius.

    ``query`` and ``word`` index members and words of ``planes``; ``beyond`` has the members that do not count.
    """
    digits = max(1, radius.bit_length())
    spare = (1 << digits) - 1 - radius                          # counters begin here, so they run over past the radius
    count = [np.full(len(query), _ALL if spare >> k & 1 else 0, np.uint64) for k in range(digits)]
    at = np.arange(len(query))
    own, shift, beyond = query >> 6, (query & 63).astype(np.uint64), beyond.copy()
    for p in range(64):
        plane = planes[p]
        bit = (plane[own] >> shift) & np.uint64(1)
        carry = plane[word] ^ (np.uint64(0) - bit)              # all ones where the query's bit is set
        for k in range(digits):
            count[k], carry = count[k] ^ carry, count[k] & carry
        beyond |= carry
        if p % 4 == 3 and p >= 2 * radius:
            open_ = np.flatnonzero(beyond != _ALL)
            if 4 * len(open_) < 3 * len(at):
                at, word, own, shift, beyond = at[open_], word[open_], own[open_], shift[open_], beyond[open_]
                count = [c[open_] for c in count]
                if not len(at):
                    break
    return at, ~beyond


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; label[x] is the smallest member of x's set, before and after."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def local_components(values: np.ndarray, first: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Of buckets values[first[i]:first[i+1]]: for every member the index of the smallest one that it reaches."""
    size = np.diff(first)
    words = -(-size // 64)
    base = np.concatenate([[0], np.cumsum(words)])              # each bucket begins at a word of its own
    bucket = np.repeat(np.arange(len(size)), size)
    slot = 64 * base[bucket] + np.arange(len(values)) - first[bucket]
    room = np.zeros(64 * base[-1], np.uint64)
    room[slot] = values
    member = np.full(len(room), -1, np.int64)
    member[slot] = np.arange(len(values))
    planes = bit_planes(room)
    empty = np.packbits(member < 0, bitorder="little").view("<u8")
    label = np.arange(len(values))
    # a query meets the words from its own on; in its own only the later members
    pairs = base[bucket + 1] - (slot >> 6)
    total = np.concatenate([[0], np.cumsum(pairs)])
    for i in range(0, int(total[-1]), PAIRS):
        k = np.arange(i, min(i + PAIRS, int(total[-1])))
        who = np.searchsorted(total, k, side="right") - 1
        query = slot[who]
        nth = k - total[who]
        word = (query >> 6) + nth
        upto = np.where(nth == 0, (np.uint64(2) << (query & 63).astype(np.uint64)) - np.uint64(1), np.uint64(0))  # 2 << 63 wraps to 0: all
        at, near = within_radius(planes, query, word, empty[word] | upto, radius)
        hit = np.flatnonzero(near)
        if len(hit):
            bits = np.unpackbits(near[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, c = np.nonzero(bits)
            _unite(label, who[at[hit[r]]], member[64 * word[at[hit[r]]] + c])
    return label


# ----------------------------------------------------------------- buckets
def block_masks(radius: int = RADIUS) -> list[int]:
    """Masks of three of ``radius + 3`` blocks of the 64 bits, every choice, as signed numbers."""
    edge = [round(64 * k / (radius + 3)) for k in range(radius + 4)]
    block = [(1 << b) - (1 << a) for a, b in zip(edge, edge[1:])]
    masks = [sum(x) for x in combinations(block, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def bucket_links(ws: Workspace, classes: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """Links (x, y), y < x, that connect the distinct fingerprints ``fp`` within ``radius`` bits, at most one for each member of a bucket."""
    keys = classes.select("fp", F.explode(F.array(*(
        F.struct(F.lit(t).alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for t, m in enumerate(block_masks(radius))))).alias("b")
    ).select("fp", "b.mask", "b.bits")
    hot = ws.stage(keys.groupBy("mask", "bits").agg(F.count("*").alias("n")).where(F.col("n") > cell)
                .select("mask", "bits", F.ceil(2 * F.col("n") / cell).cast("int").alias("parts")), "hot")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: q != part)
    cells = F.transform(others, lambda q: F.least(q, part) * F.col("parts") + F.greatest(q, part))
    dealt = (keys.join(hot, ["mask", "bits"], "left")
             .select("mask", "bits", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(cells)).alias("cell"), "fp"))

    def run(batches):
        held = np.zeros((0, 4), np.int64)                       # the last bucket of a batch may go on in the next
        for b in _with_end(batches):
            if b is not None:
                held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1)])
            if not len(held):
                continue
            first = np.flatnonzero(np.concatenate([[True], (held[1:, :3] != held[:-1, :3]).any(axis=1)]))
            upto = len(held) if b is None else int(first[-1])
            size = np.diff(np.append(first, len(held)))
            if b is not None:
                first, size = first[:-1], size[:-1]
            many = size > 1
            rows = held[:upto, 3][np.repeat(many, size)]
            held = held[upto:]
            if len(rows):
                label = local_components(rows.view(np.uint64), np.concatenate([[0], np.cumsum(size[many])]), radius)
                own = np.flatnonzero(label != np.arange(len(rows)))
                yield pa.RecordBatch.from_arrays([pa.array(rows[own]), pa.array(rows[label[own]])], ["x", "y"])

    return (dealt.repartition("mask", "bits", "cell").sortWithinPartitions("mask", "bits", "cell", "fp")
            .mapInArrow(run, "x bigint, y bigint").distinct())


def _with_end(batches):
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    ws = Workspace(docs.sparkSession, "sliced")
    table = stage(document_fingerprints(doc_columns(docs, id_col, text_col)), "sliced-docs")
    classes = ws.stage(table.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "classes")
    labels = components(ws.stage(bucket_links(ws, classes, radius), "links"), "labels", ws)
    named = ws.stage(classes.join(labels, classes.fp == labels.cls, "left")
                  .select("fp", "low", "n", F.coalesce("label", "fp").alias("label")), "named")
    lowest = ws.stage(named.groupBy("label").agg(F.min("low").alias("component_id"), F.sum("n").alias("rows")).where("rows > 1").drop("rows"), "lowest")
    found = stage(named.join(lowest, "label").select("fp", "component_id"), "sliced-found")
    ws.close()
    return table.join(found, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
