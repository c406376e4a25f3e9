"""SimHash classes, vector codes and hard negatives against brute force, on odd rows."""

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from razonete.llm import dual_tree_codes, packed_negatives, sliced_simhash, vectors
from razonete.llm.common import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ----------------------------------------------------------------- SimHash
def simhash(text):
    w = WORD.findall((text or "").translate(LOWER))
    s = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closed(fps, radius=3):
    """Smallest index that each fingerprint reaches."""
    low = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= radius and low[a] != low[b]:
                x, y = max(low[a], low[b]), min(low[a], low[b])
                low = [y if v == x else v for v in low]
    return low


def test_simhash_rows(spark):
    base = " ".join(f"w{i} and é{i % 7}" for i in range(400))
    texts = [base, base.upper(), base + " tail", "x " + base, None, "", " \n\t", "one", "One", "a b", "a  b", "a b c", "the cat\n" * 500,
             "z" * 5000 + " y\x0bx\x85 w", " ".join(f"q{i}" for i in range(300_000)), base.replace("w7 ", "v7 "), " ".join(f"u{i}" for i in range(90))]
    rows = [(i, t, 5, "f") for i, t in enumerate(texts)] + [(3, "another row of id three", 5, "f"), (None, base, 5, "f"), (None, "no copy of this text", 5, "f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int, fingerprint string").repartition(3)
    got = sliced_simhash.near_duplicates(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    fps = [simhash(r[1]) for r in order]
    low = closed(fps)
    want = sorted((str(r[0]), f"{f:016x}", str(order[k][0])) for r, f, k in zip(order, fps, low))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert len(set(low)) < len(low) - 5
    assert sliced_simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_links_of_every_distance(spark):
    """Chains, dense groups, hot buckets cut into cells: the classes of all pairs."""
    rng = np.random.default_rng(4)
    flip = lambda x, n: x ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    fps = {0}
    for _ in range(12):
        x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        for _ in range(30):
            fps.add(x := flip(x, int(rng.integers(1, 6))))
    centre = 0xDEADBEEF12345678
    fps |= {flip(centre, int(rng.integers(1, 4))) for _ in range(200)}
    fps = sorted(fps, key=lambda x: x - (1 << 64) if x >> 63 else x)
    low = closed(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp bigint")
    for cell in (8192, 40):
        links = [(r.x % (1 << 64), r.y % (1 << 64)) for r in sliced_simhash.bucket_links(Workspace(spark, "t"), df, cell=cell).collect()]
        at = {f: k for k, f in enumerate(fps)}
        got = list(range(len(fps)))
        for x, y in links:
            a, b = max(got[at[x]], got[at[y]]), min(got[at[x]], got[at[y]])
            got = [b if v == a else v for v in got]
        assert got == low


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 8])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    values = rng.integers(0, 1 << 63, 5, dtype=np.uint64)[rng.integers(0, 5, 192)]
    values ^= np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (rng.integers(1, 9), 192)).astype(np.uint64), axis=0)
    planes = sliced_simhash.bit_planes(values)
    query, word = np.repeat(np.arange(192), 3), np.tile(np.arange(3), 192)
    at, near = sliced_simhash.within_radius(planes, query, word, np.zeros(len(query), np.uint64), radius)
    got = {(int(query[a]), int(word[a]) * 64 + b) for a, n in zip(at, near.tolist()) for b in range(64) if n >> b & 1}
    assert got == {(i, j) for i in range(192) for j in range(192) if bin(int(values[i] ^ values[j])).count("1") <= radius}


# ----------------------------------------------------------- vector codes
def odd_vectors(n=300, width=64, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(9, width)) * 0.2
    rows = [(int(i), [float(np.float32(x)) for x in centre[i % 9] + rng.normal(size=width) * 0.05], int(i % 4) if i % 13 else None) for i in rng.permutation(n)]
    rows += [rows[0], (7, rows[1][1], 2), (None, rows[2][1], 1), (900, None, 1), (901, [None] + rows[3][1][1:], 1), (902, [math.nan] * width, 2),
             (903, [math.inf] + rows[3][1][1:], 1), (904, [0.0] * width, 3), (905, rows[4][1], 0), (1000, rows[5][1], 1), (1000, rows[5][1], 1), (1100, [-1.0] * width, 0)]
    return rows


SCHEMA = "vec_id bigint, embedding array<float>, label int"


def integer(rows):
    return [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def brute_codes(rows, parts, entries, rounds):
    rows = integer(rows)
    d = len(rows[0][1]) // parts
    cut = [[tuple(v[p * d:(p + 1) * d]) for p in range(parts)] for _, v, _ in rows]
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(c[p], books[p])[1] for c in cut]
            books[p] = [tuple(sum(c[p][x] for c, o in zip(cut, own) if o == j) // own.count(j) for x in range(d)) if j in own else e for j, e in enumerate(books[p])]
    best = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(f for f, _ in b) for b in best]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{j:02x}" for _, j in b), e, sum(x for x, q in zip(error, rows) if q[2] == r[2]), sha) for r, b, e in zip(rows, best, error))


@pytest.mark.parametrize("n", [300, 20])
def test_codes(spark, n):
    rows = odd_vectors(n)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"code": F.lit(1), "error": F.lit("x"), "vector": F.lit(2)}).repartition(3)
    got = dual_tree_codes.codes(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((str(r.vec_id), *r[1:]) for r in got.collect()) == brute_codes(rows, 16, 64, 2)


def test_codes_small_tables(spark):
    assert dual_tree_codes.codes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert dual_tree_codes.codes(spark.createDataFrame([(1, None, 1), (2, [math.nan], 1)], SCHEMA)).count() == 0
    one = dual_tree_codes.codes(spark.createDataFrame([(1, [0.5, -0.001], None), (2, [0.5], None)], SCHEMA)).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in one) == [(1, "00" * 16, 0, 0), (2, "00" + "01" + "00" * 14, 0, 0)]
    with pytest.raises(ValueError, match="64 bits"):
        dual_tree_codes.codes(spark.createDataFrame([(1, [1e30], 1)], SCHEMA))


@pytest.mark.parametrize("n,k,d,spread", [(1, 1, 1, 3), (31, 5, 2, 4), (1000, 64, 4, 30), (5000, 37, 3, 6), (4096, 64, 8, 200), (700, 64, 2, 100_000)])
def test_dual_tree(n, k, d, spread):
    """Trees against all distances, with many ties and repeated entries."""
    rng = np.random.default_rng(n)
    rows, books = rng.integers(-spread, spread, (3, n, d)), rng.integers(-spread, spread, (3, k, d))
    rows[1] = np.sort(rows[1], axis=0)
    books[2, k // 2:] = books[2, :k - k // 2]
    got = dual_tree_codes.dual_tree_assign(rows, books)
    for t in range(3):
        far = ((rows[t][:, None, :] - books[t][None]) ** 2).sum(2)
        assert (got.entry[t] == far.argmin(1)).all()
        assert (got.counts[t] == np.bincount(far.argmin(1), minlength=k)).all()
        assert all((got.totals[t, j] == rows[t][far.argmin(1) == j].sum(0)).all() for j in range(k))


# --------------------------------------------------------- hard negatives
@pytest.mark.parametrize("most", [1, 300, 1 << 20, 1 << 26])
def test_packed_products(most):
    rng = np.random.default_rng(most)
    rows, anchors = rng.integers(-most, most + 1, (130, 24)), rng.integers(-most, most + 1, (9, 24))
    anchors[0], rows[0] = 0, 0
    assert (packed_negatives.PackedRows(rows).scores(anchors) == anchors @ rows.T).all()
    assert (packed_negatives.PackedRows(np.abs(rows)).scores(np.abs(anchors)) == np.abs(anchors) @ np.abs(rows).T).all()


def brute_negatives(rows, every):
    rows = [(i, np.array(v), c) for i, v, c in integer(rows) if c is not None]
    out = []
    for a, (i, v, c) in enumerate(rows):
        if i is None or i % every:
            continue
        score = sorted((-int(v @ w), j is None, j or 0, c == q) for b, (j, w, q) in enumerate(rows) if b != a)
        for p in [x for x in score if x[3]][:5]:
            inside = [x for x in score if not x[3] and 80 * -p[0] <= 100 * -x[0] <= 100 * -p[0]]
            out += [(i, None if p[1] else p[2], k + 1, None if x[1] else x[2], -p[0], -x[0]) for k, x in enumerate(inside[:5])]
    return sorted(map(str, out))


def test_negatives(spark):
    rows = odd_vectors(300, 16)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"uid": F.lit(1), "block": F.lit("x"), "rank": F.lit(2)}).repartition(3)
    want = brute_negatives(rows, 10)
    assert len(want) > 300
    got = packed_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    small = packed_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, block=37, block_anchors=4)
    assert sorted(str(tuple(r)) for r in small.collect()) == want


def test_negatives_meet_without_broadcast(spark):
    """Tables that the planner sees as small are not sent to the driver, whatever their number of copies."""
    rows = odd_vectors(300, 16)
    used = vectors.usable_vectors(spark.createDataFrame(rows, SCHEMA).where("label is not null"), "vec_id", "embedding", label=F.col("label").cast("long"),
                                  anchor=F.coalesce(F.col("vec_id") % 10 == 0, F.lit(False)))
    blocks = packed_negatives.stage(packed_negatives.row_blocks(used, 16, 37), "rows")
    anchors = packed_negatives.anchor_rows(blocks, 16)
    own = packed_negatives.stage(packed_negatives._anchor_blocks(anchors, anchors.count(), "cast(null as array<struct<id:bigint,score:bigint>>)", 4), "anchors")
    cells = packed_negatives._cells(blocks, own)
    assert "Broadcast" not in cells._jdf.queryExecution().executedPlan().toString()
    assert cells.count() == cells.select("block", "uids").distinct().count() == blocks.count() * own.count() > 1


def test_negatives_small_tables(spark):
    for rows in ([], [(100, None, 1)], [(100, [1.0], 1)], [(100, [1.0], None), (200, [1.0], 1)], [(100, [1.0], 1), (1, [1.0], 1)], [(1, [1.0], 1), (2, [1.0], 2)]):
        assert packed_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0).count() == 0
    tie = [(100, [1.0], 1), (3, [1.0], 1), (2, [1.0], 1), (9, [1.0], 2), (8, [1.0], 2), (7, [0.8], 3), (6, [0.79], 3)]
    got = packed_negatives.hard_negatives(spark.createDataFrame(tie, SCHEMA), F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.positive_id, r.rank, r.negative_id) for r in got) == [(2, 1, 8), (2, 2, 9), (3, 1, 8), (3, 2, 9)]  # floor(204.8) is below 80%


def test_matrix_of_short_vectors():
    assert vectors.matrix(pa.array([[0.5], [], [-0.001, 1.0]], pa.list_(pa.float64())), 3).tolist() == [[128, 0, 0], [0, 0, 0], [-1, 256, 0]]
