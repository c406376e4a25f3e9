"""Document statistics and a monotone boosted-tree verdict over them.

The statistics of every whole text come from byte masks and word hashes (see
``textscan``); base rules reject a text at once, and gradient-boosted trees
give the verdict on the rest. Trees grow on histograms of a bounded sample of
labelled rows (``MAX_ROWS``), with monotonic constraints: more symbols, repeats,
repeated lines or capitals never raise a text's score. The fitted trees are
flattened into arrays (feature, threshold, children, value) and a batch is
scored by walking all its rows down one level at a time.

Defined cases: a null text has no words, is base-failed and not kept; a null
or repeated id keeps one result per row; labels that are null, or that
disagree for an id, count as 0 if any label of the id is 0; without labels of
both kinds the verdict is the base rules' alone; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, map_batches, mix64, text_column
from .textscan import SPACE, code_points, rolling, run_starts, span_hash, words

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
MAX_ROWS = 20_000          # labelled rows to fit on, at most
KEEP_AT = 0.5              # a text with at least this probability of label 1 is kept
FEATURES = ["symbols", "dup_lines", "repeat_words", "capitals", "marks", "word_length", "log_words"]
#: -1: the score never rises with the feature; 0: free
MONOTONE = np.array([-1, -1, -1, -1, -1, 0, 0])
STATS = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def _earlier_equal(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Mask: an equal key occurs earlier in the same group."""
    k = mix64(key + (group.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    _, first, inverse = np.unique(k, return_index=True, return_inverse=True)
    return first[inverse] != np.arange(len(k))


def statistics(text: pa.LargeStringArray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The named counts of each text, and the feature matrix made of them."""
    w = words(text)
    n = len(text)
    data, off = w.data, w.offsets
    chars = code_points(data)
    per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off])  # noqa: E731  sum over the bytes of each text
    doc = w.doc
    word_chars = np.bincount(doc, chars[w.end] - chars[w.start], n).astype(np.int64)
    # lines: spans between line breaks and text borders
    begins = np.zeros(len(data) + 1, bool)
    begins[np.flatnonzero(data == 10) + 1] = True
    begins[off[:-1]] = True
    start = np.flatnonzero(begins[:len(data)])
    stop = np.append(start[1:], len(data)) if len(start) else start
    stop = stop - ((stop > start) & (data[np.maximum(stop - 1, 0)] == 10)) if len(start) else stop
    solid = np.concatenate([[0], np.cumsum(~SPACE[data])])
    real = solid[stop] > solid[start]
    start, stop = start[real], stop[real]
    line_doc = np.searchsorted(off, start, side="right") - 1
    dup = _earlier_equal(line_doc, span_hash(data, start, stop))
    # words inside a 3-word window that occurs twice or more in its text
    ok = run_starts(w.first, 3)
    at = np.flatnonzero(ok)
    g = rolling(w.hash, 3)[at]
    k = mix64(g + (doc[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, times = np.unique(k, return_inverse=True, return_counts=True)
    twice = at[times[inverse] > 1]
    covered = np.zeros(len(w.hash), bool)
    for j in range(3):
        covered[twice + j] = True
    counts = {"n_words": w.counts.astype(np.int64), "word_chars": word_chars,
              "n_symbols": per(SYMBOLS[data]).astype(np.int64), "n_dup_lines": np.bincount(line_doc[dup], minlength=n).astype(np.int64),
              "n_repeat_words": np.bincount(doc[covered], minlength=n).astype(np.int64)}
    some = np.maximum(counts["n_words"], 1)
    features = np.stack([
        counts["n_symbols"] / some, counts["n_dup_lines"] / np.maximum(np.bincount(line_doc, minlength=n), 1),
        counts["n_repeat_words"] / some, per((data >= 65) & (data <= 90)) / np.maximum(word_chars, 1),
        per((data == 33) | (data == 63)) / some, word_chars / some, np.log1p(counts["n_words"])], axis=1)
    return counts, features


# ------------------------------------------------------------ boosted trees
@dataclass
class Trees:
    """All trees in flat arrays; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                go = x[rows, self.feature[at]] <= self.threshold[at]
                at = np.where(go, self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2,
              bins: int = 64, l2: float = 1.0, least: int = 5) -> Trees:
    """Second-order boosting of the logistic loss on quantile histograms.

    A split that breaks a feature's constraint is not taken, and the middle of
    the two child values bounds all leaves below either child, so the whole
    ensemble is monotone in that feature.
    """
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    cuts = [np.unique(np.append(c, (v[0] + v[1]) / 2)) if len(v := np.unique(col)[:2]) == 2 else c for c, col in zip(cuts, x.T)]
    code = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], axis=1)
    width = max(len(c) for c in cuts) + 1
    base = float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    margin = np.full(len(y), base)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            g, h = grad[rows].sum(), hess[rows].sum()
            value = float(np.clip(-g / (h + l2), low, high))
            me = len(nodes)
            nodes.append([0, 0.0, me, me, rate * value])
            best = (1e-6, -1, -1, 0.0, 0.0)
            if level < depth and len(rows) >= 2 * least:
                for f in range(x.shape[1]):
                    c = code[rows, f]
                    gl = np.cumsum(np.bincount(c, grad[rows], width))[:-1]
                    hl = np.cumsum(np.bincount(c, hess[rows], width))[:-1]
                    nl = np.cumsum(np.bincount(c, minlength=width))[:-1]
                    vl = np.clip(-gl / (hl + l2), low, high)
                    vr = np.clip(-(g - gl) / (h - hl + l2), low, high)
                    gain = gl ** 2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g ** 2 / (h + l2)
                    bad = (nl < least) | (len(rows) - nl < least) | (monotone[f] * (vr - vl) < 0)
                    gain[bad] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0] and k < len(cuts[f]):
                        best = (float(gain[k]), f, k, float(vl[k]), float(vr[k]))
            _, f, k, vl, vr = best
            if f >= 0:
                go = code[rows, f] <= k
                mid = (vl + vr) / 2
                bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[int(monotone[f])]
                a = grow(rows[go], level + 1, *bounds[0])
                b = grow(rows[~go], level + 1, *bounds[1])
                nodes[me][:4] = [f, float(cuts[f][k]), a, b]
            else:
                margin[rows] += rate * value
            return me

        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    flat = np.array(nodes)
    return Trees(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4],
                 np.array(roots), depth, base)


def labelled_ids(labels: DataFrame, per_label: int, id_col: str = "doc_id", label_col: str = "quality",
                 where=None) -> DataFrame:
    """At most ``per_label`` ids of each label, the first in the order of the ids' hashes (ties: the id)."""
    own = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
           .where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label")))
    if where is not None:
        own = own.where(where)
    order = [F.xxhash64("doc_id", F.lit(17)), F.col("doc_id")]
    parts = [own.where(F.col("label") == v).orderBy(*order).limit(per_label) for v in (0, 1)]
    return parts[0].unionByName(parts[1])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Trees | None:
    """Fit on at most ``max_rows`` labelled rows; their features (not texts) come to the driver."""
    ids = labelled_ids(labels, max_rows // 2, id_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        _, x = statistics(text_column(b))
        return pa.RecordBatch.from_arrays([b.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], ["label", "x"])

    own = doc_columns(docs, id_col, text_col).join(F.broadcast(ids), "doc_id")  # ids: at most max_rows rows
    rows = map_batches(own.select("doc_id", "text", "label"), run, "label int, x array<double>")
    got = rows.orderBy(F.xxhash64("x"), "label").limit(2 * max_rows).toArrow()  # a bound also where ids repeat
    y = np.array(got.column("label").to_pylist(), float)
    if len(set(y)) < 2:
        return None
    x = np.array(got.column("x").to_pylist(), float)
    order = np.lexsort((*x.T, y))  # the same rows in the same order in every run
    return fit_trees(x[order], y[order], MONOTONE)


def apply_rules(docs: DataFrame, trees: Trees | None, keep_at: float = KEEP_AT, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Statistics, base_failed, score and kept of every whole text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        counts, x = statistics(text_column(b))
        score = trees.score(x) if trees is not None else np.ones(len(x))
        failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
        return pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array(v) for v in counts.values()), pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep_at))],
            ["doc_id", *counts, "base_failed", "score", "kept"])

    return map_batches(doc_columns(docs, id_col, text_col), run, f"{STATS}, base_failed boolean, score double, kept boolean")
