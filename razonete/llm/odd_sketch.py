"""Near-duplicate classes by banded MinHash, odd sketches and an exact check.

1. A document's set is its distinct ``SHINGLE``-word shingles (the whole
   sequence if shorter). Its MinHash samples are cut into ``BANDS`` bands of
   ``ROWS`` values and folded into an odd sketch: a bitmap in which every
   sample flips one bit.
2. Documents of equal sets form a class. Classes that agree in a band share a
   bucket.
3. The first round compares every member of a bucket with the bucket's
   smallest member only. The symmetric difference of two sketches (the
   population count of their XOR) estimates the similarity; pairs well below
   the threshold are dropped, the rest are confirmed on their full sets.
4. Confirmed links are closed to components. Buckets that still hold several
   components are open: up to ``HEAD_ROUNDS`` times, while that finds a link for
   every ``HEAD_YIELD`` pairs, the members outside an open bucket's largest
   component are compared with another member of it, drawn by hash. New links
   join whole components, so only those are closed anew.
5. The members of buckets that are open then are not paired inside the bucket:
   each is dealt by the rarest shingles of its set, so many that two sets above
   the threshold must share one (prefix filtering; shingles that only one
   component has come first, so they lead to no pair). Where members of
   different components meet, the task that holds them compares odd sketches
   of their whole sets: every shingle flips a bit, so the population count of
   the XOR is at most the symmetric difference, and pairs that cannot reach the
   threshold are dropped on the spot. The others are checked like the first pairs.

The last step is exact: it drops no pair above the threshold, and members
that share only common shingles do not meet.

Sizes: nothing but a bit filter of a fixed size passes through the driver. Copies
meet in map-side aggregates. Hot keys are joined with salts, or between written
tables, where Spark splits them.

Shingles are told apart by 64-bit hashes, sets by two 64-bit keys. Defined
cases: texts without words (null, empty) link with nothing; a null id
links with nothing and keeps its row, its component is null; rows that share
an id are placed each by its own text; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, bit_positions, bits_hit, collect_two, doc_columns, map_batches, mix64, pack_two, row_slices, salted_join, stage, text_column, tidy
from .textscan import rolling, run_starts, words

SHINGLE, MIN_PERCENT = 5, 75
BANDS, ROWS = 48, 4
SKETCH_LONGS = 8                 # 512 bits
LOWEST_ESTIMATE = 0.5            # over five standard errors of 192 samples below 0.75
ID_FILTER_BITS, ID_FILTER_HASHES = 1 << 23, 2
HEAD_ROUNDS, HEAD_YIELD = 4, 50
CELL, SET_SKETCH_LONGS = 4096, 32  # entries of one task's comparison; 2,048 bits
PAIRS_PER_SALT = 256             # a member of more pairs than this is dealt over several tasks
_A = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_X = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
SETS = "doc_id bigint, n_shingles bigint, cls bigint, other bigint, bands array<bigint>, sketch array<bigint>"


def shingle_sets(text: pa.LargeStringArray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and where each text's begin."""
    w = words(text, lower=True)
    n = len(text)
    at = np.flatnonzero(run_starts(w.first, shingle))
    h, doc = rolling(w.hash, shingle)[at], w.doc[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < shingle))
    whole = np.array([rolling(w.hash[w.first[i]:w.first[i + 1]], int(w.counts[i]))[0] for i in short], np.uint64)
    h, doc = np.concatenate([h, whole]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(n + 1))


def signatures(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (n, BANDS) and odd sketches (n, SKETCH_LONGS) of non-empty sets."""
    n = len(first) - 1
    mins = np.empty((n, BANDS * ROWS), np.uint64)
    for k in range(BANDS * ROWS):
        mins[:, k] = np.minimum.reduceat((h ^ _X[k]) * _A[k], first[:-1])
    bands = np.zeros((n, BANDS), np.uint64)
    for r in range(ROWS):
        bands = mix64(bands + mins[:, r::ROWS])
    bands = mix64(bands + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bit = (mix64(mins + _X) % np.uint64(64 * SKETCH_LONGS)).astype(np.int64)
    odd = np.bincount((bit + np.arange(n)[:, None] * (64 * SKETCH_LONGS)).ravel(), minlength=n * 64 * SKETCH_LONGS) & 1
    sketch = np.packbits(odd.astype(np.uint8).reshape(n, -1), axis=1).view(np.int64)
    return bands.view(np.int64), sketch


def set_keys(h: np.ndarray, first: np.ndarray, seed: int = 0x94D049BB133111EB) -> np.ndarray:
    """A 64-bit key of each non-empty set, from the sum of its re-hashed members."""
    return mix64(np.add.reduceat(mix64(h ^ np.uint64(seed)), first[:-1])).view(np.int64) if len(h) else np.zeros(0, np.int64)


def document_sets(docs: DataFrame) -> DataFrame:
    """One row per document: set size, two keys of the set, band keys and sketch; nulls for empty sets."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        h, first = shingle_sets(text_column(b))
        size = np.diff(first)
        full = np.flatnonzero(size > 0)
        cls: list = [None] * len(size)
        other: list = [None] * len(size)
        bands: list = [None] * len(size)
        sketch: list = [None] * len(size)
        if len(full):
            cut = np.append(first[full], len(h))
            for i, c, o, x, y in zip(full.tolist(), set_keys(h, cut).tolist(), set_keys(h, cut, 0xD6E8FEB86659FD93).tolist(), *signatures(h, cut)):
                cls[i], other[i], bands[i], sketch[i] = c, o, x, y
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(size, pa.int64()), pa.array(cls, pa.int64()), pa.array(other, pa.int64()),
             pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "cls", "other", "bands", "sketch"])

    return map_batches(docs, run, SETS)


# ------------------------------------------------------------ exact check
def _dealt(ws: Workspace, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs with a salt, and the (y, salt) rows they use: one for every ``PAIRS_PER_SALT`` pairs of y."""
    pairs = ws.stage(pairs, "pairs")
    of = ws.stage(pairs.groupBy("y").agg(F.ceil(F.count("*") / PAIRS_PER_SALT).cast("long").alias("salts")), "salts")
    own = pairs.join(of, "y").select("x", "y", F.pmod(F.xxhash64("x"), F.col("salts")).alias("salt"))
    return own, of.select("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))


def _confirmed(ws: Workspace, pairs: DataFrame, sets: DataFrame, min_percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets pass; ``y`` may be hot."""
    own, ys = _dealt(ws, pairs)
    right = ys.join(sets.select(F.col("cls").alias("y"), F.col("members").alias("ym")), "y")
    both = own.join(right, ["y", "salt"]).join(sets.select(F.col("cls").alias("x"), F.col("members").alias("xm")), "x")

    def run(batches):
        for b in batches:
            good = []
            for p, q in zip(b.column(2), b.column(3)):
                p, q = np.frombuffer(p.as_buffer(), "<u8"), np.frombuffer(q.as_buffer(), "<u8")
                at = np.searchsorted(p, q)
                both = int((p[np.minimum(at, len(p) - 1)] == q).sum())
                good.append(100 * both >= min_percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["x", "y"]).filter(pa.array(good, pa.bool_()))

    return both.select("x", "y", "xm", "ym").mapInArrow(tidy(run), "x bigint, y bigint")


def _near(ws: Workspace, pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose odd sketches do not rule them out."""
    own, ys = _dealt(ws, pairs)
    xs = reps.select(F.col("cls").alias("x"), F.col("sketch").alias("sx"))
    right = ys.join(reps.select(F.col("cls").alias("y"), F.col("sketch").alias("sy")), "y")
    both = own.join(right, ["y", "salt"]).join(xs, "x")
    differ = sum((F.bit_count(F.col("sx")[k].bitwiseXOR(F.col("sy")[k])) for k in range(SKETCH_LONGS)), F.lit(0))
    bits, samples = 64 * SKETCH_LONGS, BANDS * ROWS
    share = F.greatest(1 - 2 * differ / F.lit(bits), F.lit(1e-9))
    estimate = 1 + F.log(share) * F.lit(bits / (4 * samples))
    return both.where(estimate >= LOWEST_ESTIMATE).select("x", "y")


def components(edges: DataFrame, name: str = "labels", ws: Workspace | None = None) -> DataFrame:
    """(cls, label): the smallest node that each node of ``edges`` (x, y) reaches.

    Every round takes the smallest label among the neighbours and then follows
    that label's own label; labels are written to the shared folder each round.
    """
    write = ws.stage if ws else stage
    both = write(edges.select("x", "y").union(edges.select(F.col("y"), F.col("x"))), f"{name}-edges")
    labels = write(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("cls"), F.least("x", "m").alias("label")), name)
    while True:
        seen = (both.join(labels.select(F.col("cls").alias("y"), "label"), "y")
                .groupBy(F.col("x").alias("cls")).agg(F.min("label").alias("near")))
        step = labels.join(seen, "cls").select("cls", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("cls").alias("low"), F.col("label").alias("next"))
        new = write(step.join(jump, "low", "left").select("cls", F.least("low", "next").alias("label"),
                                                          (F.least("low", "next") < F.col("label")).alias("moved")), name)
        labels = new.select("cls", "label")
        if new.where("moved").isEmpty():
            return labels


def joined_components(labels: DataFrame, edges: DataFrame, name: str, ws: Workspace) -> DataFrame:
    """``labels`` (cls, label) after the new ``edges`` (x, y), closed over the components that they join."""
    x, y = labels.select(F.col("cls").alias("x"), F.col("label").alias("lx")), labels.select(F.col("cls").alias("y"), F.col("label").alias("ly"))
    between = edges.join(x, "x", "left").join(y, "y", "left").select(F.coalesce("lx", "x").alias("x"), F.coalesce("ly", "y").alias("y"))
    top = components(between.where("x != y").distinct(), name, ws).select(F.col("cls").alias("label"), F.col("label").alias("low"))
    old = salted_join(labels, top, ["label"], [F.col("cls")], salts=4).select("cls", F.coalesce("low", "label").alias("label"))
    alone = top.select(F.col("label").alias("cls"), F.col("low").alias("label")).join(labels.select("cls"), "cls", "left_anti")
    return ws.stage(old.unionByName(alone), name)


def _open_members(ws: Workspace, shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, cls, label) of the members of buckets that hold several components."""
    named = ws.stage(salted_join(shared.select("bucket", "cls"), labels, ["cls"], [F.col("bucket")], salts=4)
                     .select("bucket", "cls", F.coalesce("label", "cls").alias("label")), "named")
    several = ws.stage(named.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("bucket"), "several")
    return ws.stage(named.join(several, "bucket"), "open")


def _head_pairs(ws: Workspace, open_: DataFrame, done: DataFrame, seed: int) -> DataFrame:
    """Pairs of the members outside their bucket's largest component and a member of it, without those in ``done``."""
    drawn = open_.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("cls", F.lit(seed)), "cls")).alias("head"))
    main = ws.stage(drawn.groupBy("bucket").agg(F.max(F.struct("n", "label", "head")).alias("m"))
                    .select("bucket", F.col("m.label").alias("main"), F.col("m.head.cls").alias("head")), "main")
    pairs = open_.join(main, "bucket").where("label != main").select(F.greatest("cls", "head").alias("x"), F.least("cls", "head").alias("y")).distinct()
    return pairs.join(done, ["x", "y"], "left_anti")


def _rare_pairs(ws: Workspace, open_: DataFrame, sets: DataFrame, done: DataFrame, min_percent: int) -> DataFrame:
    """Pairs (x, y) of different components that can reach ``min_percent``, without those in ``done``.

    All sets order their shingles alike: those of one component only, then by
    how many open sets have them. Two sets that reach the threshold share one
    among the first n - ceil(p n / 100) + 1 of the larger and the first
    n - ceil(2 p n / (100 + p)) + 1 of the smaller.
    """
    own = ws.stage(open_.join(sets, "cls"), "open-sets")

    def exploded(batches):
        for b in batches:
            sets_of = [np.frombuffer(raw.as_buffer(), "<i8") for raw in b.column(2)]
            n = np.array([len(h) for h in sets_of], np.int64)
            row = np.repeat(np.arange(len(n)), n)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(n[row]), pa.array(
                np.concatenate([*sets_of, np.zeros(0, np.int64)]))], ["cls", "label", "n", "h"])

    grams = own.select("cls", "label", "members").mapInArrow(tidy(exploded), "cls bigint, label bigint, n bigint, h bigint")
    common = ws.stage(grams.groupBy("h").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("times"))
                      .where("a < b").select("h", "times"), "common")  # shingles of several components
    met = grams.join(common, "h").groupBy("cls", "label", "n").agg(F.sort_array(F.collect_list(F.struct("times", "h"))).alias("list"))
    n, p = F.col("n"), F.lit(min_percent)
    probe = n - F.ceil(p * n / 100) + 1                 # counted over the whole set; shingles of one component come first
    index = n - F.ceil(2 * p * n / (100 + p)) + 1
    place = n - F.size("list") + F.col("pos") + 1
    entries = ws.stage(met.select("cls", "label", "n", F.posexplode("list").alias("pos", "g"), "list").where(place <= probe)
                       .select("cls", "label", "n", F.col("g.h").alias("h"), (place <= index).alias("first")), "entries")
    # shingles at which members of several components meet, large ones cut into parts that meet pair by pair
    keys = ws.stage(entries.groupBy("h").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.max("first").alias("first"), F.count("*").alias("times"))
                    .where("a < b and first").select("h", F.when(F.col("times") > CELL, F.ceil(2 * F.col("times") / CELL)).otherwise(1).cast("int").alias("parts")), "keys")
    part = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: q != part)
    cells = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.transform(others, lambda q: F.least(q, part) * F.col("parts") + F.greatest(q, part)))
    marks = ws.stage(own.select("cls", "members").mapInArrow(tidy(_set_sketches), "cls bigint, sketch array<bigint>"), "marks")
    met = (entries.join(keys, "h").join(marks, "cls").select("h", F.explode(cells).alias("cell"), F.struct("cls", "label", "n", "first", "sketch").alias("e"))
           .groupBy("h", "cell").agg(F.collect_list("e").alias("list")).select("list"))
    pairs = met.mapInArrow(tidy(_meeting(min_percent)), "x bigint, y bigint").distinct()
    return pairs.join(done, ["x", "y"], "left_anti")


def _set_sketches(batches):
    """Odd sketches of whole sets: (cls, members) to (cls, sketch)."""
    bits = 64 * SET_SKETCH_LONGS
    for b in batches:
        sets_of = [np.frombuffer(raw.as_buffer(), "<u8") for raw in b.column(1)]
        row = np.repeat(np.arange(len(sets_of)), [len(h) for h in sets_of])
        bit = (mix64(np.concatenate([*sets_of, np.zeros(0, np.uint64)]) ^ _X[0]) % np.uint64(bits)).astype(np.int64)
        odd = np.bincount(row * bits + bit, minlength=len(sets_of) * bits) & 1
        sketch = np.packbits(odd.astype(np.uint8).reshape(-1, bits), axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(sketch), pa.list_(pa.int64()))], ["cls", "sketch"])


def _meeting(min_percent: int, at_once: int = 1 << 16):
    """Pairs (x, y) of each list of entries whose labels differ and whose sizes and sketches allow the threshold."""

    def run(batches):
        for b in batches:
            for item in b.column(0):
                e = item.values
                col = {e.type.field(k).name: e.field(k) for k in range(e.type.num_fields)}
                cls, label, n = (col[k].to_numpy(zero_copy_only=False) for k in ("cls", "label", "n"))
                first = np.flatnonzero(col["first"].to_numpy(zero_copy_only=False))
                sketch = col["sketch"].flatten().to_numpy().view(np.uint64).reshape(len(cls), -1)
                for i in range(0, len(first), max(1, at_once // len(cls))):
                    a = first[i:i + max(1, at_once // len(cls))]
                    r, c = np.nonzero((label[a][:, None] != label[None, :]) & (n[a][:, None] <= n[None, :]) & (100 * n[a][:, None] >= min_percent * n[None, :]))
                    r = a[r]
                    apart = np.bitwise_count(sketch[r] ^ sketch[c]).sum(axis=1, dtype=np.int64)  # at most the symmetric difference
                    both = n[r] + n[c]
                    able = 100 * (both - apart) >= min_percent * (both + apart)
                    x, y = cls[r[able]], cls[c[able]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["x", "y"])

    return run


def _grouped(docs: DataFrame, min_percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, cls) of all rows, and (doc_id, cls, label) of the rows that can link: rows of one label are one group."""
    spark = docs.sparkSession
    ws = Workspace(spark, "odd")
    docs = doc_columns(docs, id_col, text_col)
    rows = ws.stage(document_sets(docs), "sets")
    # sets of one key and another second key (as good as never) are classes of their own
    twins = ws.stage(rows.groupBy("cls").agg(F.min("other").alias("o"), F.max("other").alias("p")).where("o < p").select(F.col("cls").alias("twin")), "twins")
    renamed = not twins.isEmpty()
    if renamed:
        rows = rows.join(twins, F.col("cls") == F.col("twin"), "left").withColumn(
            "cls", F.when(F.col("twin").isNotNull(), F.xxhash64("cls", "other")).otherwise(F.col("cls"))).drop("twin")
    table = stage(rows.select("doc_id", "n_shingles", "cls"), "odd-table")
    linked = rows.where("n_shingles > 0 and doc_id is not null")
    classes = ws.stage(linked.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    entries = classes.select("cls", F.explode("bands").alias("bucket"))
    heads = ws.stage(entries.groupBy("bucket").agg(F.min("cls").alias("head"), F.max("cls").alias("last")).where("head < last").drop("last"), "heads")
    shared = ws.stage(entries.join(heads, "bucket"), "buckets")
    wanted = ws.stage(shared.select("cls").distinct(), "wanted")
    reps = ws.stage(classes.select("cls", "sketch", "doc_id").join(wanted, "cls"), "reps")
    star = ws.stage(shared.where("cls > head").select(F.col("cls").alias("x"), F.col("head").alias("y")).distinct(), "star")

    # the full sets of the classes in shared buckets, from their first documents
    def positions(batches):
        for b in batches:
            ids = b.column(0).to_numpy().astype(np.int64).view(np.uint64)
            yield pack_two(bit_positions(ids, ID_FILTER_BITS, ID_FILTER_HASHES), np.zeros(0, np.uint64), ID_FILTER_BITS)

    sent = spark.sparkContext.broadcast(collect_two(
        reps.select("doc_id").mapInArrow(tidy(positions), "piece int, pos binary, again binary"), ID_FILTER_BITS, ("seen",))[0])

    def full_sets(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        h, first = shingle_sets(text_column(b.filter(pa.array(bits_hit(sent.value, ids, ID_FILTER_HASHES)))))
        first = np.append(first[:-1][np.diff(first) > 0], len(h))
        return pa.RecordBatch.from_arrays([pa.array(set_keys(h, first)), pa.array(set_keys(h, first, 0xD6E8FEB86659FD93)), pa.array(
            [h[i:j].astype("<u8").tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary())], ["cls", "other", "members"])

    sets = map_batches(docs.where("doc_id is not null"), full_sets, "cls bigint, other bigint, members binary")
    if renamed:
        sets = sets.join(twins, F.col("cls") == F.col("twin"), "left").withColumn(
            "cls", F.when(F.col("twin").isNotNull(), F.xxhash64("cls", "other")).otherwise(F.col("cls")))
    sets = ws.stage(sets.select("cls", "members").join(wanted, "cls", "left_semi").dropDuplicates(["cls"]), "full")
    edges = ws.stage(_confirmed(ws, _near(ws, star, reps), sets, min_percent), "links")
    done = star
    labels = components(edges, "odd-labels", ws)
    open_ = _open_members(ws, shared, labels)
    for seed in range(1, HEAD_ROUNDS + 1):
        tested = ws.stage(_head_pairs(ws, open_, done, seed), "heads")
        found = ws.stage(_confirmed(ws, _near(ws, tested, reps), sets, min_percent), "links")
        done = done.union(tested)
        n = found.count()
        if n:
            labels = joined_components(labels, found, "odd-labels", ws)
            open_ = _open_members(ws, shared, labels)
        if n * HEAD_YIELD < tested.count() or not n:
            break
    if not open_.isEmpty():
        pairs = _rare_pairs(ws, open_.select("cls", "label").distinct(), sets, done, min_percent)
        found = ws.stage(_confirmed(ws, _near(ws, pairs, reps), sets, min_percent), "links")
        if not found.isEmpty():
            labels = joined_components(labels, found, "odd-labels", ws)
    named = stage(salted_join(linked.select("doc_id", "cls"), labels, ["cls"], [F.col("doc_id")], salts=8)
                  .select("doc_id", "cls", F.coalesce("label", "cls").alias("label")), "odd-named")
    ws.close()
    return table, named


def near_duplicates(docs: DataFrame, min_percent: int = MIN_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; one id of each component is kept."""
    table, named = _grouped(docs, min_percent, id_col, text_col)
    lowest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.max("doc_id").alias("last"))
    found = stage(lowest.where("component_id < last").select("label", "component_id"), "odd-lowest")
    joined = salted_join(named, found, ["label"], [F.col("doc_id")], salts=8).select(
        F.col("doc_id").alias("id"), F.col("cls").alias("c"), "component_id").where("component_id is not null").distinct()
    row = table.select("doc_id", "n_shingles", "cls")
    return (row.join(joined, (row.doc_id == joined.id) & (row.cls == joined.c), "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def drop_near_duplicates(docs: DataFrame, min_percent: int = MIN_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one row of each group, all rows without words or id.

    A group's row is that of its smallest id and, where rows share that id, of
    its smallest class; of rows that share both, the first by text and the
    other columns. Rows are told apart by id and class where an id repeats.
    """
    table, named = _grouped(docs, min_percent, id_col, text_col)
    keys = stage(named.groupBy("label", "doc_id", "cls").count(), "odd-keys")
    first = (keys.groupBy("label").agg(F.min(F.struct("doc_id", "cls")).alias("first"), F.sum("count").alias("n"))
             .where("n > 1").select("label", "first"))
    verdict = stage(salted_join(keys, stage(first, "odd-first"), ["label"], [F.col("doc_id"), F.col("cls")], salts=8, how="inner").select(
        "doc_id", "cls", "count", (F.struct("doc_id", "cls") == F.col("first")).alias("stays")), "odd-verdict")
    gone = verdict.where("not stays").select(F.col("doc_id").alias("_id"), F.col("cls").alias("_c"))
    ids = table.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    own = F.col(id_col).cast("long")
    if ids.isEmpty():
        return docs.join(gone.select("_id"), own == F.col("_id"), "left_anti")

    def run(batches):
        for b in batches:
            for i, j in row_slices(text_column(b, text_col)):
                part = b.slice(i, j - i)
                h, at = shingle_sets(text_column(part, text_col))
                full = np.flatnonzero(np.diff(at) > 0)
                cls = np.zeros(len(part), np.int64)
                cls[full] = set_keys(h, np.append(at[full], len(h)))
                none = np.ones(len(part), bool)
                none[full] = False
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cls, mask=none)], [*part.schema.names, "_cls"])

    kept = (docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField("_cls", T.LongType())]))
            .join(gone, (own == F.col("_id")) & (F.col("_cls") == F.col("_c")), "left_anti"))
    again = verdict.where("stays and count > 1").select(F.col("doc_id").alias("_id"), F.col("cls").alias("_c"))
    if again.isEmpty():
        return kept.select(*docs.columns)
    same = (own == F.col("_id")) & (F.col("_cls") == F.col("_c"))
    sortable = [F.col(f.name) for f in docs.schema.fields if f.name != text_col and "map<" not in f.dataType.simpleString()]
    one = (kept.join(again, same, "left_semi").groupBy(own, "_cls")
           .agg(F.min_by(F.struct(*docs.columns), F.struct(text_col, *sortable)).alias("_row")).select("_row.*"))
    return kept.join(again, same, "left_anti").select(*docs.columns).unionByName(one)
