"""Encode texts by their space-separated segments, each distinct one once.

The splitting pattern of byte-level BPE never joins characters across the
border between a non-space character and a following space, so a text's ids
are those of its segments (each with the space before it) in a row. Only a
run of white space that holds a space followed by more white space (or by the
end of the text) reads differently in parts; such a text is one segment.

Segments are found and hashed in the UTF-8 buffer with arrays and looked up in
an open-addressing table of the worker process. The table tells segments apart
by two independent 64-bit hashes of all their bytes (128 bits together); it
grows with the distinct segments and is emptied when full.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex

from .textscan import span_hash, text_bytes

#: where a split at spaces would change the pieces; \s as the splitting pattern has it
UNSAFE = regex.compile(r"\s (?:\s|$)")
CACHE_ENTRIES = 2_000_000
_MAYBE_SPACE = np.zeros(256, bool)  # bytes that are or may belong to white space
_MAYBE_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21), *range(0x80, 0x100)]] = True


class _Table:
    """hash -> (offset, count) into a pool of ids."""

    def __init__(self, bits: int = 16):
        self.pool, self.used = np.zeros(1 << 18, "<u4"), 0
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.bits, self.entries = bits, 0
        self.key = np.zeros(1 << bits, np.uint64)
        self.check = np.zeros(1 << bits, np.uint64)
        self.at = np.zeros(1 << bits, np.int64)
        self.count = np.full(1 << bits, -1, np.int32)  # -1: free

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Slots of the keys, -1 where missing."""
        mask = (1 << self.bits) - 1
        slot = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(key), -1, np.int64)
        left = np.arange(len(key))
        while len(left):
            s = slot[left]
            full = self.count[s] >= 0
            hit = full & (self.key[s] == key[left]) & (self.check[s] == check[left])
            out[left[hit]] = s[hit]
            left = left[full & ~hit]
            slot[left] = (slot[left] + 1) & mask
        return out

    def insert(self, key: np.ndarray, check: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
        """Keys that are not there yet, each once."""
        if 2 * (self.entries + len(key)) > 1 << self.bits:
            old = self.count >= 0
            rows = self.key[old], self.check[old], self.at[old], self.count[old]
            self._make(max(16, int(2 * (len(rows[0]) + len(key))).bit_length()))
            self.insert(*rows)
        self.entries += len(key)
        mask = (1 << self.bits) - 1
        slot = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(key))
        owner = np.full(1 << self.bits, -1, np.int32) if len(key) else None
        while len(left):
            s = slot[left]
            free = self.count[s] < 0
            owner[s[free]] = left[free]  # of several for one slot, one stays
            won = free & (owner[s] == left)
            w = left[won]
            self.key[s[won]], self.check[s[won]], self.at[s[won]], self.count[s[won]] = key[w], check[w], at[w], count[w]
            left = left[~won]
            slot[left] = (slot[left] + 1) & mask

    def add_ids(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer(b"".join(ids), "<u4")
        count = np.array([len(x) // 4 for x in ids], np.int64)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool) // 2, len(flat)), "<u4")])
        self.pool[self.used:self.used + len(flat)] = flat
        at = self.used + np.cumsum(count) - count
        self.used += len(flat)
        return at, count.astype(np.int32)


class SegmentEncoder:
    """``encode_new(list of distinct strings) -> list of id bytes`` (little-endian uint32) behind the table."""

    def __init__(self, encode_new: Callable[[list[str]], list[bytes]], entries: int = CACHE_ENTRIES):
        self.encode_new = encode_new
        self.entries = entries
        self.table = _Table()

    def _spans(self, text: pa.LargeStringArray, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the segments and, for each text, the index of its first one."""
        space = np.flatnonzero(data == 0x20)
        if len(space):
            after = np.append(_MAYBE_SPACE[data], True)[space + 1]
            after |= np.isin(space + 1, off)  # the end of a text
            before = _MAYBE_SPACE[data[np.maximum(space - 1, 0)]]
            suspect = np.unique(np.searchsorted(off, space[after & before], side="right") - 1)
            unsafe = [i for i in suspect.tolist() if UNSAFE.search(text[i].as_py())]
            if unsafe:
                space = space[~np.isin(np.searchsorted(off, space, side="right") - 1, unsafe)]
        begins = np.zeros(len(data), bool)
        begins[space] = True
        begins[off[:-1][off[:-1] < off[1:]]] = True
        start = np.flatnonzero(begins)
        return start, np.searchsorted(start, off)

    def encode(self, text: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        data, off = text_bytes(text)
        start, first = self._spans(text, data, off)
        if not len(start):
            return np.zeros(0, "<u4"), np.zeros(len(text), np.int64)
        end = np.append(start[1:], len(data))
        key = span_hash(data, start, end)
        check = span_hash(data, start, end, 1)
        if self.table.entries > self.entries:
            self.table = _Table()
        table = self.table
        slot = table.find(key, check)
        miss = np.flatnonzero(slot < 0)
        if len(miss):
            _, one = np.unique(key[miss], return_index=True)
            if len(one) < len(miss):  # two segments of one hash in the batch are told apart by the check
                both = np.stack([key[miss], check[miss]], axis=1)
                order = np.lexsort((both[:, 1], both[:, 0]))
                new = np.ones(len(order), bool)
                new[1:] = (both[order][1:] != both[order][:-1]).any(axis=1)
                one = order[new]
            own = miss[one]
            raw = data.tobytes()
            at, count = table.add_ids(self.encode_new([raw[a:b].decode() for a, b in zip(start[own].tolist(), end[own].tolist())]))
            table.insert(key[own], check[own], at, count)
            slot = table.find(key, check)
        count = table.count[slot].astype(np.int64)
        ends = np.cumsum(count)
        flat = table.pool[np.repeat(table.at[slot] - (ends - count), count) + np.arange(int(ends[-1]))]
        ends = np.concatenate([[0], ends])
        return flat, np.diff(ends[first])
