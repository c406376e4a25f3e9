"""Byte-level BPE by rounds over padded matrices of pieces.

A batch's distinct pieces are bucketed by byte length into padded numpy
matrices of token ids. In a round every row merges its leftmost pair of
minimum rank: the ranks of all adjacent pairs stand beside the matrix, only
the two pairs that touch the merged token are looked up anew (in an open
hash table of pairs), the row is closed up by one place, and rows without a
pair left leave the matrix. Ids equal those of the reference algorithm over the
same ranks: a piece that is itself a token is that token, all else is merged
from single bytes.

Defined cases: a null text is empty and has no ids; texts of any length are
encoded whole; a piece of over ``LONG_PIECE`` bytes is a matrix of one row, in
which a round merges all pairs of minimum rank that merging one by one would.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import doc_columns, map_batches, text_column
from .segments import SegmentEncoder

LONG_PIECE = 1 << 11
CACHE_ENTRIES = 400_000  # segments that a worker process remembers
SLICE_BYTES = 1 << 18  # text that is encoded at once: its arrays are many times as large
_PAD = 0xFFFF  # an id without pairs; ranks stay below it
_NONE = np.iinfo(np.int32).max
_encoders: dict[tuple[str, str], BpeEncoder] = {}


class PairTable:
    """Open-addressing hash table (left id, right id) -> rank of the joined token, probed with arrays."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(4 * max(1, len(pairs))))))
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.vals = np.full(1 << self.bits, _NONE, np.int32)
        left, slot, self.probes = np.arange(len(pairs)), self._slot(pairs), 0
        while len(left):
            self.probes += 1
            at = slot[left]
            free = self.keys[at] == np.uint64(0xFFFFFFFFFFFFFFFF)
            self.keys[at[free]] = pairs[left[free]]  # of several for one slot, one stays
            won = self.keys[at] == pairs[left]
            self.vals[at[won]] = ranks[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = ((a.astype(np.uint64) << np.uint64(16)) | b.astype(np.uint64)).ravel()
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.vals[slot], _NONE)
        open_ = np.flatnonzero((out == _NONE) & (self.keys[slot] != np.uint64(0xFFFFFFFFFFFFFFFF)))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.vals[slot[open_[hit]]]
            open_ = open_[~hit & (there != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return out.reshape(a.shape)


class BpeEncoder:
    def __init__(self, ranks_file: str, pattern: str):
        with open(ranks_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        if max(self.ranks.values()) >= _PAD:
            raise ValueError("ranks of 65535 and more are not supported")
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.uint16)
        pairs, ranks = [], []
        for t, r in self.ranks.items():
            for k in range(1, len(t)):
                a, b = self.ranks.get(t[:k]), self.ranks.get(t[k:])
                if a is not None and b is not None:
                    pairs.append(a << 16 | b)
                    ranks.append(r)
        self.table = PairTable(np.array(pairs, np.uint64), np.array(ranks, np.int32))
        self.split = regex.compile(pattern).findall
        self.segments = SegmentEncoder(self._encode_new, CACHE_ENTRIES)

    # ---------------------------------------------------------------- merging
    def _merge_matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids (little-endian uint32 bytes) of pieces of at most ``width`` bytes."""
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        length = np.array([len(p) for p in pieces])
        ids = self.byte_ids[raw]
        ids[np.arange(width)[None, :] >= length[:, None]] = _PAD
        rank = self.table.rank(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((n, 0), _NONE, np.int32)
        rows = np.arange(n)
        out: list[bytes] = [b""] * n

        def leave(which: np.ndarray) -> None:
            wide = ids[which].astype("<u4")
            for r, row, m in zip(rows[which].tolist(), wide, length[rows[which]].tolist()):
                out[r] = row[:m].tobytes()

        while len(rows):
            if rank.shape[1] == 0:
                leave(np.ones(len(rows), bool))
                break
            at = rank.argmin(axis=1)  # the first of equal minima: the leftmost
            here = np.arange(len(rows))
            least = rank[here, at]
            done = least == _NONE
            if done.any():
                leave(done)
                keep = ~done
                ids, rank, rows, at, least = ids[keep], rank[keep], rows[keep], at[keep], least[keep]
                if not len(rows):
                    break
                here = np.arange(len(rows))
            w = ids.shape[1]
            ids[here, at] = least.astype(np.uint16)
            length[rows] -= 1
            # close up: everything behind the merged pair moves one place to the left
            col = np.arange(w - 1)[None, :]
            ids = np.where(col <= at[:, None], ids[:, :-1], ids[:, 1:])
            if w > 2:
                rank = np.where(col[:, :-1] < at[:, None], rank[:, :-1], rank[:, 1:])
                inner = at < w - 2
                rank[here[inner], at[inner]] = self.table.rank(ids[here[inner], at[inner]], ids[here[inner], at[inner] + 1])
                outer = at > 0
                rank[here[outer], at[outer] - 1] = self.table.rank(ids[here[outer], at[outer] - 1], ids[here[outer], at[outer]])
            else:
                rank = rank[:, :0]
        return out

    def _merge_row(self, piece: bytes) -> bytes:
        """One long piece as a matrix of one row, the same merges with many of them in a round.

        The pairs of minimum rank are merged from the left, overlapping ones every other, as one after the other
        would. A merge that makes a pair of a lower rank ends the round, since that pair comes next.
        """
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        rank = np.append(self.table.rank(ids[:-1], ids[1:]), np.int32(_NONE))  # of each id with the one behind it
        while (least := rank.min()) != _NONE:
            at = np.flatnonzero(rank == least)
            order = np.arange(len(at))
            first = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) == 1, 0, order))  # of its run of neighbours
            at = at[(order - first) % 2 == 0]
            merged = np.full(len(at), least, np.uint16)
            before = np.where(at > 0, ids[at - 1], np.uint16(_PAD))
            before[1:][np.diff(at) == 2] = least  # merged in this round, too
            behind = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], np.uint16(_PAD))
            lower = (self.table.rank(before, merged) < least) | (self.table.rank(merged, behind) < least)
            if lower.any():
                at = at[:lower.argmax() + 1]
            ids[at] = least
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, rank = ids[keep], rank[keep]
            here = at - np.arange(len(at))
            here = np.union1d(here, here[here > 0] - 1)
            last = here == len(ids) - 1
            rank[here[last]] = _NONE
            here = here[~last]
            rank[here] = self.table.rank(ids[here], ids[here + 1])
        return ids.astype("<u4").tobytes()

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct pieces."""
        out: dict[str, bytes] = {}
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode()
            if (r := self.ranks.get(raw)) is not None:
                out[p] = r.to_bytes(4, "little")
            elif len(raw) > LONG_PIECE:
                out[p] = self._merge_row(raw)
            else:
                n = len(raw)
                buckets.setdefault(n + (-n) % 4 if n <= 32 else 1 << (n - 1).bit_length(), []).append((p, raw))
        for width, own in buckets.items():
            step = max(1, (1 << 18) // width)  # cells of a matrix
            for a in range(0, len(own), step):
                part = own[a:a + step]
                out.update(zip([p for p, _ in part], self._merge_matrix([raw for _, raw in part], width)))
        return out

    def _encode_new(self, new: list[str]) -> list[bytes]:
        split = self.split
        parts = [split(s) for s in new]
        ids = self.encode_pieces(list(set().union(*parts)))
        get = ids.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    # -------------------------------------------------------------- interface
    def encode_batch(self, text: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        return self.segments.encode(text)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def encoder(ranks_file: str, pattern: str) -> BpeEncoder:
    """One encoder a worker process."""
    if (ranks_file, pattern) not in _encoders:
        _encoders[ranks_file, pattern] = BpeEncoder(ranks_file, pattern)
    return _encoders[ranks_file, pattern]


def encode(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) of every whole text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        flat, count = encoder(ranks_file, pattern).encode_batch(text_column(b))
        ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.ListArray.from_arrays(
            pa.array(ends), pa.array(flat.astype(np.int32)))], ["doc_id", "n_tokens", "ids"])

    return map_batches(doc_columns(docs, id_col, text_col), run, "doc_id bigint, n_tokens bigint, ids array<int>", SLICE_BYTES)


def decode(encoded: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """(doc_id, bytes): the bytes that the ids stand for."""

    def run(batches):
        for b in batches:
            enc = encoder(ranks_file, pattern)
            lists = b.column(1)
            raw = [enc.decode(np.array(x, "<u4")) for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, bytes binary")


def round_trip(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, its ids decoded, digests of both."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(ranks_file, pattern)
        flat, count = enc.encode_batch(text_column(b))
        ends = np.cumsum(count).tolist()
        ids, raw = [], []
        for a, e in zip([0, *ends], ends):
            own = flat[a:e]
            ids.append(hashlib.sha256(" ".join(map(enc.decimal.__getitem__, own.tolist())).encode()).hexdigest())
            raw.append(hashlib.sha256(enc.decode(own)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(doc_columns(docs, id_col, text_col), run,
                       "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", SLICE_BYTES)
