"""Attention-based multiple-instance learning of document quality.

A document is a bag of passages (``PASSAGE_WORDS`` words each, the whole text).
Every passage is turned into byte-class densities and word-repetition rates
and encoded by a learned layer; gated attention, learned from document
labels alone, weighs the passages, and a logistic unit scores the weighted
passage representation. Features and scores of all documents are computed in
the tasks; the model is fitted on all passages of a bounded sample of labelled
documents, drawn by hash and taken as long as their passages fit the bound.
Scores use all passages of all documents.

Defined cases: a null or empty text is a bag of one empty passage and gets a
score like any other; rows that share an id are scored one by one; labels that
disagree for an id count as 0; without labels of both kinds every score is the
share of label 1 (0.5 without labels); other columns are never inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, map_batches, mix64, row_slices, stage, text_column, tidy
from .text_rules import labelled_ids
from .textscan import Words, words

PASSAGE_WORDS = 64
MAX_DOCS = 4_000           # labelled documents to fit on, at most (half of either label)
MAX_PASSAGES = 256_000     # of all documents to fit on, together: that many feature rows come to the driver
SLICE_BYTES = 1 << 18      # text of a slice; its arrays take about 35 bytes for each byte of text
THRESHOLD = 0.7
HIDDEN, ATTENTION, EPOCHS, RATE, DECAY, SEED = 24, 12, 150, 0.02, 1e-4, 7
#: byte classes: ASCII marks one by one, then groups
_MARKS = "#*$%&|<>!?.,;:-_/\\=+~^@'\"()[]{}"
_CLASS = np.full(256, len(_MARKS) + 5, np.uint8)  # the rest
for _i, _c in enumerate(_MARKS):
    _CLASS[ord(_c)] = _i
for _k, _r in enumerate((range(65, 91), range(97, 123), range(48, 58), (10,), range(128, 256))):
    _CLASS[list(_r)] = len(_MARKS) + _k
_CLASSES = len(_MARKS) + 6
DIM = _CLASSES + 5


def passages(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages and the first row of each text (a text without words has one row of zeros)."""
    n = np.maximum(1, -(-w.counts // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(n)), n)
    a = w.first[owner] + (np.arange(first[-1]) - first[owner]) * PASSAGE_WORDS   # word range of each passage
    b = np.minimum(a + PASSAGE_WORDS, w.first[owner + 1])
    some = b > a
    x = np.zeros((len(owner), DIM))
    if some.any():
        lo, hi = w.start[a[some]], w.end[b[some] - 1]
        span = hi - lo
        row = np.repeat(np.arange(len(lo)), span)
        at = np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span) + np.repeat(lo, span)
        hist = np.bincount(row * _CLASSES + _CLASS[w.data[at]], minlength=len(lo) * _CLASSES).reshape(-1, _CLASSES)
        x[some, :_CLASSES] = hist / span[:, None]
        h, size = w.hash, (b - a)[some]
        rate = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[np.stack([a[some], b[some]])], axis=0)[0] / size
        inside = np.zeros(len(h), np.int64)  # place of a word in its passage
        inside[a[some]] = np.concatenate([a[some][:1], size[:-1]])
        place = np.arange(len(h)) - np.cumsum(inside)
        for k in (1, 2):
            same = np.zeros(len(h), bool)
            same[k:] = (h[k:] == h[:-k]) & (place[k:] >= k)
            x[some, _CLASSES + k - 1] = rate(same)
        part = np.cumsum(place == 0).astype(np.uint64)
        _, one = np.unique(mix64(h + part * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        fresh = np.zeros(len(h), bool)
        fresh[one] = True
        length = w.end - w.start
        x[some, _CLASSES + 2] = rate(~fresh)
        x[some, _CLASSES + 3] = rate(length == 1)
        x[some, _CLASSES + 4] = np.minimum(rate(length) / 20, 2)
    return x, first


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    prior: float | None = None  # set: a constant score

    def _forward(self, x: np.ndarray, first: np.ndarray):
        p = self.p
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[owner])
        att = e / np.add.reduceat(e, first[:-1])[owner]
        z = np.add.reduceat(att[:, None] * h, first[:-1], axis=0)
        return owner, h, t, g, att, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -30, 30)))

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(first) - 1, self.prior)
        return self._forward((x - self.mean) / self.scale, first)[-1]


def fit_model(x: np.ndarray, first: np.ndarray, y: np.ndarray) -> Model:
    """Full-batch Adam on the logistic loss, both labels of equal weight; deterministic."""
    rng = np.random.default_rng(SEED)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 0.01)
    p = {"W": rng.normal(0, 0.2, (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, ATTENTION)),
         "U": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "w": rng.normal(0, 0.3, ATTENTION), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}
    model = Model(mean, scale, p)
    xs = (x - mean) / scale
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    for step in range(1, EPOCHS + 1):
        owner, h, t, g, att, z, s = model._forward(xs, first)
        ds = weight * (s - y)
        dz = ds[:, None] * p["c"]
        datt = (h * dz[owner]).sum(axis=1)
        de = att * (datt - np.add.reduceat(att * datt, first[:-1])[owner])
        dt, dg = de[:, None] * p["w"] * g * (1 - t ** 2), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (att[:, None] * dz[owner] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h ** 2)
        grads = {"W": xs.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ ds, "d": np.array([ds.sum()])}
        for k, a in p.items():
            d = grads[k] + DECAY * a
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.999 * v[k] + 0.001 * d ** 2
            a -= RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 4, is 2 (a null id is not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_passages: int = MAX_PASSAGES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``max_docs`` labelled documents of at most ``max_passages`` passages together, each whole.

    Documents are taken in the order of a hash; one that does not fit any more is passed over.
    """
    ids = labelled_ids(labels, max_docs // 2, id_col, where=~held_out(F.col("doc_id")))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x, first = passages(words(text_column(b)))
        raw = x.astype("<f4")
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.diff(first), pa.int64()), pa.array(
            [raw[i:j].tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary())], ["doc_id", "label", "n", "x"])

    own = doc_columns(docs, id_col, text_col).join(F.broadcast(ids), "doc_id")  # ids: at most max_docs rows
    rows = stage(map_batches(own.select("doc_id", "text", "label"), run, "doc_id bigint, label int, n bigint, x binary", SLICE_BYTES), "mil-passages")
    rows = rows.withColumns({"h": F.xxhash64("doc_id"), "hx": F.xxhash64("x")})
    sizes = rows.select("h", "doc_id", "hx", "n").orderBy("h", "doc_id", "hx").limit(2 * max_docs).collect()  # a bound also where ids repeat
    taken, room = [], max_passages
    for r in sizes:
        if r.n <= room:
            taken.append((r.doc_id, r.hx))
            room -= r.n
    taken = docs.sparkSession.createDataFrame(sorted(set(taken)), "doc_id bigint, hx bigint")
    got = rows.join(F.broadcast(taken), ["doc_id", "hx"], "left_semi").orderBy("h", "doc_id", "hx").limit(len(sizes)).select("doc_id", "label", "x").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.x)))  # the same order in every run
    y = np.array([r.label for r in got], float)
    if len(set(y)) < 2:
        return Model(np.zeros(DIM), np.ones(DIM), {}, float(y.mean()) if len(y) else 0.5)
    bags = [np.frombuffer(r.x, "<f4").reshape(-1, DIM) for r in got]
    return fit_model(np.concatenate(bags).astype(float), np.concatenate([[0], np.cumsum([len(b) for b in bags])]), y)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; the score is of the whole text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(*passages(words(text_column(b)))))], ["doc_id", "score"])

    return map_batches(doc_columns(docs, id_col, text_col), run, "doc_id bigint, score double", SLICE_BYTES)


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows that the model does not reject, with all their columns."""

    def run(batches):
        for b in batches:
            for i, j in row_slices(text_column(b, text_col), SLICE_BYTES):
                part = b.slice(i, j - i)
                good = model.score(*passages(words(text_column(part, text_col)))) >= threshold
                yield part.filter(pa.array(good))

    return docs.mapInArrow(tidy(run), docs.schema)
